"""Registered queries of variable nodes, Gibbs chains and vector factors, with SQL written from the equations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .factor_queries import _KEYS, _LINES, _lines, _shown, sql_digamma
from .functions import scalar
from .math_queries import _sql_uniform
from .operators import factor_messages as fm
from .operators import matrix_messages as mm
from .operators import samplers, variables
from .workload import query, rounded, table


@query(f"""
SELECT l_orderkey, l_linenumber, round(a/va + b/vb, 6) AS marginal_tau, round(1/va + 1/vb, 6) AS marginal_prec, round(a/va, 6) AS use_tau, round(a/va + b/vb, 6) AS vmp_use_tau, round(a/va, 6) AS derived_tau,
       round((a/va + b/vb)/(1/va + 1/vb), 6) AS point, round(greatest(a+0.5-1, 0)/vb, 6) AS gamma_point, round((va+0.5)/(va+vb+1), 6) AS beta_point,
       CASE WHEN a > 2.5 THEN 0.0 ELSE round(a/va, 6) END::DOUBLE AS cut_tau, round(a/va - 0.5*b/vb, 6) AS shifted_tau, round(least(a+vb-b-va, 0), 6) AS first_score FROM ({_LINES})
""")
def variable_messages(spark: SparkSession, d: str) -> DataFrame:
    li, a, va, b, vb = _lines(spark, d)
    own, use = fm.natural(a, va), fm.natural(b, vb)
    node = variables.variable(own, use)
    scores = variables.max_marginal(F.array(a, b), F.array(vb, va))
    return _shown(
        li, marginal_tau=node["marginal"]["tau"], marginal_prec=node["marginal"]["prec"], use_tau=node["to_use"]["tau"], vmp_use_tau=variables.variable(own, use, variational=True)["to_use"]["tau"],
        derived_tau=variables.variable(own, use, variational=True, derived=True)["to_use"]["tau"], point=variables.gaussian_point(own, use), gamma_point=variables.gamma_point(a + 0.5, vb),
        beta_point=variables.beta_point(va + 1.5, vb + 1.5), cut_tau=variables.forward_when(own, a > 2.5)["tau"], shifted_tau=variables.shift_power(own, use, 0.5, 1.0)["tau"], first_score=scores[0],
    )


@query("""
WITH RECURSIVE s AS (SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0.0 END)::DOUBLE AS k FROM orders GROUP BY 1),
r AS (
  SELECT o_custkey, n, k, 0.0::DOUBLE AS x, 0.1::DOUBLE AS size, 0.0::DOUBLE AS last, 0 AS i FROM s
  UNION ALL SELECT o_custkey, n, k, x + g*w, w, g, i + 1 FROM (
    SELECT *, CASE WHEN g*last > 0 THEN size*1.2 WHEN g*last < 0 THEN size*0.5 ELSE size END AS w FROM (SELECT *, sign(k - n/(1+exp(-x)) - x/4)::DOUBLE AS g FROM r WHERE i < 100)))
SELECT o_custkey, round(x, 5) + 0.0 AS mode FROM r WHERE i = 100
""")
def point_by_gradient_signs(spark: SparkSession, d: str) -> DataFrame:
    """Mode of each customer's log odds of a large order under a Gaussian prior of variance 4."""
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum((F.col("o_totalprice") > 200000).cast("double")).alias("k"))
    mode = variables.rprop(F.lit(0.0), lambda x: F.col("k") - F.col("n") * scalar.logistic(x) - x / 4.0)
    return s.select("o_custkey", (F.round(mode, 5) + 0.0).alias("mode"))


def hierarchy_chain(mean: Column, n: Column, key: Column, prior_variance: float, between: float, noise: float, burn_in: int, thin: int, samples: int) -> Column:
    """Chain of a group's level a ~ N(0, prior_variance) and its mean b ~ N(a, between), of which n rows with noise have this mean."""
    sweeps = burn_in + thin * samples
    a_variance = 1.0 / (1.0 / prior_variance + 1.0 / between)

    def step(s: Column, t: Column) -> Column:
        k = key * sweeps + t
        a_mean = s["b"] / between * a_variance
        b_variance = F.lit(1.0) / (n / noise + 1.0 / between)

        def second(a: Column) -> Column:
            b = samplers.normal(k, (a / between + n * mean / noise) * b_variance, b_variance, 1)
            return F.struct(a.alias("a"), b.alias("b"), a_mean.alias("mean"), F.lit(a_variance).alias("variance"))

        return scalar.bound(samplers.normal(k, a_mean, F.lit(a_variance)), second)

    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("mean"), F.lit(a_variance).alias("variance"))
    return variables.gibbs(start, step, burn_in, thin, samples)


def _sql_normal(key: str, salt: int) -> str:
    return f"(sqrt(-2*ln({_sql_uniform(key, 2 * salt + 1)}))*cos(2*pi()*{_sql_uniform(key, 2 * salt + 2)}))"


@query(f"""
WITH RECURSIVE s AS (SELECT c_nationkey::BIGINT AS g, count(*)::DOUBLE AS n, avg(c_acctbal)/1000 AS x FROM customer GROUP BY 1),
c AS (
  SELECT g, n, x, 0 AS t, 0.0::DOUBLE AS b, 0.0::DOUBLE AS m FROM s
  UNION ALL SELECT g, n, x, t, (a/2 + n*x/9)/(n/9 + 0.5) + sqrt(1/(n/9 + 0.5))*{_sql_normal("(g*220 + t)", 1)}, m FROM (
    SELECT *, m + sqrt(1/0.54)*{_sql_normal("(g*220 + t)", 0)} AS a FROM (SELECT g, n, x, t + 1 AS t, b/2/0.54 AS m FROM c WHERE t < 220)))
SELECT g AS c_nationkey, round(avg(m), 5) AS level, round(1/0.54 + avg(m*m) - avg(m)*avg(m), 5) AS variance, count(*) AS samples FROM c WHERE t > 20 AND (t - 20) % 2 = 0 GROUP BY 1
""")
def gibbs_nation_levels(spark: SparkSession, d: str) -> DataFrame:
    """Each nation's level of account balances, from the conditionals of a chain over its sufficient statistics."""
    s = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("c_nationkey")).agg(F.count("*").cast("double").alias("n"), (F.avg("c_acctbal") / 1000).alias("x"))
    kept = hierarchy_chain(F.col("x"), F.col("n"), F.col("c_nationkey"), 25.0, 2.0, 9.0, 20, 2, 100)
    got = s.select("c_nationkey", kept.alias("kept")).withColumn("m", variables.mixed_conditionals(F.col("kept"), "mean", "variance"))
    return got.select("c_nationkey", F.round("m.mean", 5).alias("level"), F.round("m.variance", 5).alias("variance"), F.size("kept").cast("long").alias("samples"))


_DET = f"SELECT *, (va+2)*(vb+3) - 0.09 AS det, (2+va)*(3+vb) - 0.09 AS rdet FROM ({_LINES})"


@query(f"""
SELECT l_orderkey, l_linenumber, round(((vb+3)*a - 0.3*b)/det, 6) AS tau_0, round(((va+2)*b - 0.3*a)/det, 6) AS tau_1, round(-0.3/det, 6) AS prec_01,
       round(3*((3+vb)*a - 0.3*b)/rdet, 6) AS vmp_tau_0, round(3*(2+va)/rdet, 6) AS vmp_prec_11, round((va + (a-1)*(a-1))/2, 6) AS rate_00, round((a-1)*(b-2)/2, 6) AS rate_01,
       round(-0.5*(2*ln(2*pi()) + ln(det) + ((vb+3)*(a-1)*(a-1) - 0.6*(a-1)*(b-2) + (va+2)*(b-2)*(b-2))/det), 6) AS log_average,
       round({sql_digamma("3.0")} + {sql_digamma("2.5")} - ln(rdet), 6) AS mean_log_det,
       round(0.5*({sql_digamma("3.0")} + {sql_digamma("2.5")} - ln(rdet) - 2*ln(2*pi()) - 3*((3+vb)*(va+(a-1)*(a-1)) - 0.6*(a-1)*(b-2) + (2+va)*(vb+(b-2)*(b-2)))/rdet), 6) AS average_log,
       round(1.5*ln(va*vb) - (2+va)*va - (3+vb)*vb + 3*ln(rdet) - lgamma(3.0) - lgamma(2.5) - 0.5*ln(pi()), 5) AS log_density FROM ({_DET})
""")
def vector_factor_messages(spark: SparkSession, d: str) -> DataFrame:
    li, a, va, b, vb = _lines(spark, d)
    zero, shape = F.lit(0.0), F.lit(3.0)
    x, vx, m = F.array(a, b), F.array(va, zero, zero, vb), F.array(F.lit(1.0), F.lit(2.0))
    noise, nothing = F.array(F.lit(2.0), F.lit(0.3), F.lit(0.3), F.lit(3.0)), F.array_repeat(zero, 4)
    rate = mm.plus(vx, noise)
    # Beliefs and messages are columns first, so that each is computed once for all of its parts.
    li = li.select(*_KEYS, x.alias("x"), vx.alias("vx"), m.alias("m"), rate.alias("rate"), nothing.alias("vm")).select("*", mm.wishart(shape, F.col("rate")).alias("precision"))
    x, vx, m, rate, vm, precision = (F.col(c) for c in ("x", "vx", "m", "rate", "vm", "precision"))
    messages = {"to": mm.gaussian_to_either(x, vx, noise), "vmp": mm.gaussian_variational(x, precision), "prec": mm.precision_variational(x, vx, m, vm)}
    li = li.select("*", *[c.alias(n) for n, c in messages.items()])
    to, vmp, prec = (F.col(c) for c in messages)
    return _shown(
        li, tau_0=to["tau"][0], tau_1=to["tau"][1], prec_01=to["prec"][1], vmp_tau_0=vmp["tau"][0], vmp_prec_11=vmp["prec"][3], rate_00=prec["rate"][0], rate_01=prec["rate"][1],
        log_average=mm.gaussian_log_average(x, m, rate), mean_log_det=mm.wishart_mean_log_det(precision),
        average_log=mm.gaussian_average_log(x, vx, m, vm, precision), log_density=F.round(mm.wishart_log_density(vx, precision), 5),
    )


@query("""
WITH e AS (SELECT label, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) t(i)),
s AS (SELECT label, i, count(*) AS n, sum(x) AS s FROM e GROUP BY 1, 2)
SELECT label, i - 1 AS place, round(s/0.5, 4) AS tau, round(n/0.5, 4) AS prec, round(s/0.5/(n/0.5 + 1), 5) AS mean FROM s
""")
def vector_mean_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Mean vector of each label under noise of variance 0.5 and a unit prior: products of the rows' messages, place by place."""
    message = table(spark, d, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double") / 0.5).alias("tau"), F.transform("embedding", lambda _: F.lit(2.0)).alias("prec"))
    sums = mm.added(message, ["label"], "tau", "prec")
    flat = sums.select("label", F.posexplode(F.arrays_zip("tau", "prec")).alias("place", "m"))
    return flat.select("label", F.col("place").cast("long").alias("place"), F.round("m.tau", 4).alias("tau"), F.round("m.prec", 4).alias("prec"), F.round(F.col("m.tau") / (F.col("m.prec") + 1.0), 5).alias("mean"))
