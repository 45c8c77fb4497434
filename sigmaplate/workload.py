"""The registered queries of the engine's own operators, with the same results as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import families, scalar
from .learners import classifier, crowd, mixture
from .operators import conjugate, estimators, factors, linear_algebra, messages, metrics, recommender, relational, strings
from .plans.model import SumModel
from .streaming import posterior

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its doubles rounded, as sums in another order differ in their last digits."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Conjugate models


@query("""
SELECT c_mktsegment, n, round((100000.0/1e10 + s/1e8) / (1/1e10 + n/1e8), 4) AS mean, round(1 / (1/1e10 + n/1e8), 4) AS variance
FROM (SELECT c_mktsegment, count(*) AS n, sum(o_totalprice) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
""")
def gaussian_mean_by_segment(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_totalprice")
    rows = orders.join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return rounded(conjugate.gaussian_mean(rows, ["c_mktsegment"], F.col("o_totalprice"), 1e5, 1e10, 1e8), 4)


@query("""
SELECT l_returnflag, n, round((n*a + 25.0)/(n + 1.0), 6) AS mean, n + 1.0::DOUBLE AS kappa, n/2.0::DOUBLE + 2 AS shape,
       round(10.0 + n*v/2 + n*1.0*(a-25)*(a-25)/(2*(n+1.0)), 4) AS rate
FROM (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS a, var_pop(l_quantity) AS v FROM lineitem GROUP BY 1)
""")
def gaussian_gamma_by_flag(spark: SparkSession, d: str) -> DataFrame:
    g = conjugate.gaussian_gamma(table(spark, d, "lineitem"), ["l_returnflag"], F.col("l_quantity").cast("double"), 25.0, 1.0, 2.0, 10.0)
    return rounded(g.withColumn("rate", F.round("rate", 4)))


@query("""
SELECT lang, a AS true_count, b AS false_count, round(a/(a+b), 6) AS mean,
       round(lgamma(a)+lgamma(b)-lgamma(a+b) - (lgamma(1.0)+lgamma(1.0)-lgamma(2.0)), 6) AS log_evidence
FROM (SELECT lang, sum(toxic) + 1.0::DOUBLE AS a, count(*) - sum(toxic) + 1.0::DOUBLE AS b FROM documents JOIN labels USING (doc_id) GROUP BY lang)
""")
def beta_bernoulli_by_lang(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return rounded(conjugate.beta_bernoulli(rows, ["lang"], F.col("toxic") == 1))


@query("""
WITH c AS (SELECT user_id % 10 AS g, event_type, count(*) AS n FROM events GROUP BY 1, 2),
dom AS (SELECT DISTINCT event_type FROM c), g AS (SELECT g, sum(n) AS total FROM c GROUP BY g)
SELECT g.g AS g, dom.event_type, coalesce(n, 0) + 1.0::DOUBLE AS pseudo_count,
       round((coalesce(n, 0) + 1.0) / (total + (SELECT count(*) FROM dom)), 6) AS mean
FROM g CROSS JOIN dom LEFT JOIN c ON c.g = g.g AND c.event_type = dom.event_type
""")
def dirichlet_event_types(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("user_id") % 10).alias("g"), "event_type")
    return rounded(conjugate.dirichlet_discrete(e, ["g"], "event_type"))


@query("""
WITH c AS (SELECT c_nationkey, count(o_orderkey) AS k FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_nationkey),
s AS (SELECT c_nationkey, sum(k) + 1.0::DOUBLE AS a, count(*) + 1.0::DOUBLE AS b FROM c GROUP BY 1)
SELECT c_nationkey, a AS shape, b AS rate, round(a/b, 6) AS mean, round(lgamma(a) - lgamma(1.0) - a*ln(b) + ln(1.0), 4) AS log_evidence FROM s
""")
def gamma_poisson_orders(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("k"))
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    g = conjugate.gamma_poisson(rows, ["c_nationkey"], F.coalesce("k", F.lit(0)))
    return rounded(g.withColumn("log_evidence", F.round("log_evidence", 4)))


@query("""
WITH s AS (SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS sx, sum(l_extendedprice/1000) AS sy, sum(l_quantity*l_quantity) AS sxx, sum(l_quantity*(l_extendedprice/1000)) AS sxy FROM lineitem GROUP BY 1),
p AS (SELECT *, n/4.0 + 0.01 AS p00, sx/4.0 AS p01, sxx/4.0 + 0.01 AS p11, sy/4.0 AS t0, sxy/4.0 AS t1 FROM s)
SELECT l_returnflag, n, round((p11*t0 - p01*t1)/(p00*p11 - p01*p01), 6) AS intercept, round((p00*t1 - p01*t0)/(p00*p11 - p01*p01), 6) AS slope FROM p
""")
def bayesian_regression(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return rounded(conjugate.linear_regression(li, ["l_returnflag"], F.col("l_quantity").cast("double"), F.col("l_extendedprice") / 1000, 0.01, 4.0))


# Families and messages


@query("""
SELECT o_custkey, round(sum(o_totalprice/1e8), 6) AS tau, round(sum(1/1e8), 9) AS prec FROM orders GROUP BY 1
""")
def gaussian_product(spark: SparkSession, d: str) -> DataFrame:
    tau, prec = families.gaussian(F.col("o_totalprice"), F.lit(1e8))
    m = families.GAUSSIAN.product(table(spark, d, "orders").select("o_custkey", tau.alias("tau"), prec.alias("prec")), "o_custkey")
    return m.select("o_custkey", F.round("tau", 6).alias("tau"), F.round("prec", 9).alias("prec"))


@query("""
SELECT o_orderkey, round(sum(x) OVER w - x, 6) AS tau, count(*) OVER w - 1.0::DOUBLE AS prec
FROM (SELECT o_orderkey, o_custkey, o_totalprice/1000 AS x FROM orders) WINDOW w AS (PARTITION BY o_custkey)
""")
def replicate_cavity(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 1000).alias("tau"), F.lit(1.0).alias("prec"))
    return families.GAUSSIAN.cavity(m, "o_custkey").select("o_orderkey", F.round("tau", 6).alias("tau"), "prec")


@query("""
SELECT n_regionkey, round(sum(w*m)/sum(w), 4) AS mean, round(sum(w*(v+m*m))/sum(w) - (sum(w*m)/sum(w))**2, 2) AS variance
FROM (SELECT n_regionkey, n_nationkey, count(*)::DOUBLE AS w, avg(c_acctbal) AS m, var_pop(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY 1
""")
def mixture_moments(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    g = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_nationkey")
    g = g.agg(F.count("*").cast("double").alias("w"), F.avg("c_acctbal").alias("m"), F.var_pop("c_acctbal").alias("v"))
    got = families.moment_matched(F.col("w"), F.col("m"), F.col("v"))
    return g.groupBy("n_regionkey").agg(F.round(got["mean"], 4).alias("mean"), F.round(got["variance"], 2).alias("variance"))


@query("""
SELECT a.c_mktsegment AS s, b.c_mktsegment AS t, round(-0.5*(ln(2*pi()*(a.v+b.v)) + (a.m-b.m)**2/(a.v+b.v)), 6) AS log_average
FROM (SELECT c_mktsegment, avg(c_acctbal) AS m, var_pop(c_acctbal) AS v FROM customer GROUP BY 1) a, (SELECT c_mktsegment, avg(c_acctbal) AS m, var_pop(c_acctbal) AS v FROM customer GROUP BY 1) b
WHERE a.c_mktsegment < b.c_mktsegment
""")
def gaussian_log_average(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("m"), F.var_pop("c_acctbal").alias("v"))
    a, b = g.alias("a"), g.alias("b")
    both = a.join(b, F.col("a.c_mktsegment") < F.col("b.c_mktsegment"))
    la = families.gaussian_log_average_of(F.col("a.m"), F.col("a.v"), F.col("b.m"), F.col("b.v"))
    return both.select(F.col("a.c_mktsegment").alias("s"), F.col("b.c_mktsegment").alias("t"), F.round(la, 6).alias("log_average"))


_GATE = """
WITH c(component, w, m, v) AS (VALUES (0, 0.5, 20.0, 50.0), (1, 0.3, 50.0, 100.0), (2, 0.2, 80.0, 30.0)),
s AS (SELECT event_id, value AS x, component, ln(w) - ln(v)/2 - (value-m)**2/(2*v) AS score FROM events CROSS JOIN c),
r AS (SELECT event_id, x, component, exp(score - mx) / sum(exp(score - mx)) OVER w AS responsibility
      FROM (SELECT *, max(score) OVER (PARTITION BY event_id) AS mx FROM s) WINDOW w AS (PARTITION BY event_id))
"""
_COMPONENTS = [(0.5, 20.0, 50.0), (0.3, 50.0, 100.0), (0.2, 80.0, 30.0)]


@query(_GATE + "SELECT event_id, component, round(responsibility, 6) AS responsibility FROM r")
def gate_responsibilities(spark: SparkSession, d: str) -> DataFrame:
    g = messages.mixture_gate(table(spark, d, "events"), "event_id", F.col("value"), _COMPONENTS)
    return g.select("event_id", "component", F.round("responsibility", 6).alias("responsibility"))


@query(_GATE + """SELECT component, round(sum(responsibility)/(SELECT count(*) FROM events), 6) AS weight, round(sum(responsibility*x)/sum(responsibility), 4) AS mean,
round(sum(responsibility*x*x)/sum(responsibility) - (sum(responsibility*x)/sum(responsibility))**2, 3) AS variance FROM r GROUP BY component""")
def mixture_em_sweep(spark: SparkSession, d: str) -> DataFrame:
    new = mixture.sweep(table(spark, d, "events"), "event_id", F.col("value"), _COMPONENTS)
    rows = [(k, round(w, 6), round(m, 4), round(v, 3)) for k, (w, m, v) in enumerate(new)]
    return spark.createDataFrame(rows, "component int, weight double, mean double, variance double")


@query("""
SELECT l_returnflag, l_linestatus, l_shipmode, round((n + 1.0)/(sum(n) OVER (PARTITION BY l_returnflag, l_linestatus) + 7), 6) AS p
FROM (SELECT l_returnflag, l_linestatus, l_linenumber % 7 AS l_shipmode, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)
""")
def conditional_probability_table(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("l_shipmode", F.col("l_linenumber") % 7)
    return rounded(messages.conditional_table(li, ["l_returnflag", "l_linestatus"], "l_shipmode", 1.0, 7))


def _chain(spark: SparkSession, d: str) -> DataFrame:
    high = F.col("value") > 50
    like = [F.when(high, 0.2).otherwise(0.8), F.when(high, 0.7).otherwise(0.3)]
    return messages.forward(table(spark, d, "events"), "user_id", ["ts", "event_id"], like, [[0.9, 0.1], [0.2, 0.8]], [0.6, 0.4])


@query("""
SELECT event_id, arg_max(component, (s, -component)) AS component, round(max(s), 6) AS score
FROM (SELECT event_id, component, ln(w) - ln(v)/2 - (value-m)**2/(2*v) AS s FROM events CROSS JOIN (VALUES (0, 0.5, 20.0, 50.0), (1, 0.3, 50.0, 100.0), (2, 0.2, 80.0, 30.0)) c(component, w, m, v)) GROUP BY event_id
""")
def max_sum_component(spark: SparkSession, d: str) -> DataFrame:
    return rounded(messages.best_component(table(spark, d, "events"), "event_id", F.col("value"), _COMPONENTS))


# Scalar mathematics


@query("""
SELECT p_partkey, round(lgamma(p_size + 0.5), 6) AS lg, round(1/(1+exp(-(p_size-25)/5.0::DOUBLE)), 6) AS logistic, round(ln(1+exp(p_size/10.0::DOUBLE)), 6) AS softplus FROM part
""")
def special_functions(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size").cast("double")
    return rounded(table(spark, d, "part").select("p_partkey", scalar.gamma_ln(s + 0.5).alias("lg"), scalar.logistic((s - 25.0) / 5.0).alias("logistic"), scalar.log1p_exp(s / 10.0).alias("softplus")))


@query("""
SELECT event_id, round(exp(x - m) / sum(exp(x - m)) OVER (PARTITION BY user_id), 6) AS p
FROM (SELECT event_id, user_id, value/10.0::DOUBLE AS x, max(value/10.0::DOUBLE) OVER (PARTITION BY user_id) AS m FROM events)
""")
def softmax_by_user(spark: SparkSession, d: str) -> DataFrame:
    p = scalar.softmax_over(F.col("value") / 10.0, Window.partitionBy("user_id"))
    return table(spark, d, "events").select("event_id", F.round(p, 6).alias("p"))


@query("""
SELECT p_partkey, round(lgamma(50.0 + 1) - lgamma(p_size::DOUBLE + 1) - lgamma(51.0 - p_size), 6) AS choose, round(lgamma(p_size + 3.5) - lgamma(p_size::DOUBLE), 6) AS rising,
       round(-ln(1 + exp(-(p_size - 25.0)/5)), 6) AS logistic_log, round(ln(exp(p_size/10.0::DOUBLE) - 1), 6) AS expm1_log FROM part
""")
def combinatorial_functions(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size").cast("double")
    return rounded(table(spark, d, "part").select(
        "p_partkey", scalar.choose_ln(F.lit(50.0), s).alias("choose"), scalar.rising_factorial_ln(s, F.lit(3.5)).alias("rising"),
        scalar.logistic_ln((s - 25.0) / 5.0).alias("logistic_log"), scalar.log_expm1(s / 10.0).alias("expm1_log"),
    ))


# Closed-form factors


@query("""
SELECT l_orderkey, l_linenumber, round(p*q, 6) AS both, round(p + q - p*q, 6) AS either, round(p*q + (1-p)*(1-q), 6) AS same,
       round((0.9*q + 0.1*(1-q)) / (0.9*q + 0.1*(1-q) + 0.1), 6) AS to_first, round(0.9 / (0.9 + 0.9*q + 0.1*(1-q)), 6) AS to_first_either
FROM (SELECT l_orderkey, l_linenumber, l_quantity/51.0::DOUBLE AS p, l_discount*5.0::DOUBLE AS q FROM lineitem)
""")
def logic_messages(spark: SparkSession, d: str) -> DataFrame:
    p, q, r = F.col("l_quantity") / 51.0, F.col("l_discount") * 5.0, F.lit(0.9)
    return rounded(table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", factors.all_of(p, q).alias("both"), factors.any_of(p, q).alias("either"), factors.equal(p, q).alias("same"),
        factors.all_of_message(r, q).alias("to_first"), factors.any_of_message(r, q).alias("to_first_either"),
    ))


@query("SELECT l_orderkey, l_linenumber, round(2*l_quantity - 0.5*l_tax, 6)::DOUBLE AS mean, round(4*1.5 + 0.25*(l_discount + 1), 6)::DOUBLE AS variance FROM lineitem")
def linear_factor(spark: SparkSession, d: str) -> DataFrame:
    got = factors.linear_moments([(2.0, F.col("l_quantity").cast("double"), F.lit(1.5)), (-0.5, F.col("l_tax"), F.col("l_discount") + 1.0)])
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in got.items()]))


# Estimators


@query("""
SELECT event_type, round(sum(w*x)/sum(w), 6) AS mean, round(sum(w*x*x)/sum(w) - (sum(w*x)/sum(w))**2, 4) AS variance
FROM (SELECT event_type, value AS x, (event_id % 7 + 1)::DOUBLE AS w FROM events) GROUP BY 1
""")
def weighted_moments(spark: SparkSession, d: str) -> DataFrame:
    m = estimators.moments(table(spark, d, "events"), ["event_type"], F.col("value"), (F.col("event_id") % 7 + 1).cast("double"))
    return m.select("event_type", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


@query("""
SELECT event_type, count(x) AS n, round(avg(x), 6) AS mean, round(var_pop(x), 4) AS variance FROM (SELECT event_type, CASE WHEN event_id % 5 <> 0 THEN value END AS x FROM events) GROUP BY 1
""")
def moments_skipping_nan(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return rounded(estimators.moments_skip_nan(table(spark, d, "events"), ["event_type"], x).withColumn("variance", F.round("variance", 4)))


@query("""
SELECT l_returnflag, round(m*(m*(1-m)/v - 1), 6) AS true_count, round((1-m)*(m*(1-m)/v - 1), 6) AS false_count
FROM (SELECT l_returnflag, avg(l_discount + 0.001) AS m, var_pop(l_discount + 0.001) AS v FROM lineitem GROUP BY 1)
""")
def beta_estimator(spark: SparkSession, d: str) -> DataFrame:
    return rounded(estimators.beta_by_moments(table(spark, d, "lineitem"), ["l_returnflag"], F.col("l_discount") + 0.001))


@query("""
SELECT o_orderpriority, round(m*m/v, 6) AS shape, round(m/v, 9) AS rate FROM (SELECT o_orderpriority, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1)
""")
def gamma_estimator(spark: SparkSession, d: str) -> DataFrame:
    g = estimators.gamma_by_moments(table(spark, d, "orders"), ["o_orderpriority"], F.col("o_totalprice"))
    return g.select("o_orderpriority", F.round("shape", 6).alias("shape"), F.round("rate", 9).alias("rate"))


@query("""
SELECT source, value, n, round(n/sum(n) OVER (PARTITION BY source), 6) AS probability FROM (SELECT source, lang AS value, count(*) AS n FROM documents GROUP BY 1, 2)
""")
def discrete_estimator(spark: SparkSession, d: str) -> DataFrame:
    return rounded(estimators.histogram(table(spark, d, "documents").select("source", "lang"), ["source"], F.col("lang")))


@query("""
WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, p, value AS quantile FROM s CROSS JOIN (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) q(p) WHERE k = least(floor(p*n), n - 1)
""")
def exact_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return estimators.quantiles(table(spark, d, "events"), ["event_type"], "value", [0.1, 0.5, 0.9])


@query("""
SELECT event_type, i, round(list_extract(quantile_cont(value, [1/6, 2/6, 3/6, 4/6, 5/6]), i + 1), 6) AS quantile FROM events, (SELECT unnest(range(0, 5))::INT AS i) GROUP BY event_type, i
""")
def inner_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(estimators.interpolated_quantiles(table(spark, d, "events"), ["event_type"], "value", 5, True))


@query("""
SELECT event_type, i, round(list_extract(quantile_cont(value, [0.0, 0.25, 0.5, 0.75, 1.0]), i + 1), 6) AS quantile FROM events, (SELECT unnest(range(0, 5))::INT AS i) GROUP BY event_type, i
""")
def outer_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(estimators.interpolated_quantiles(table(spark, d, "events"), ["event_type"], "value", 5, False))


@query("""
SELECT user_id % 50 AS chain, count(value) AS n, round(avg(value), 6) AS mean FROM events WHERE event_id >= 200 AND (event_id - 200) % 3 = 0 GROUP BY 1
""")
def burn_in_means(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("chain", F.col("user_id") % 50)
    return rounded(estimators.after_burn_in(e, ["chain"], "event_id", 200, 3, F.col("value")))


# Metrics: labels of documents against a reproducible score

_SCORED = "SELECT doc_id, lang, source, quality = 1 AS positive, (n_chars % 97) / 97.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return both.select("doc_id", "lang", "source", (F.col("quality") == 1).alias("positive"), ((F.col("n_chars") % 97) / 97.0).alias("score"))


@query(f"""
WITH g AS (SELECT lang, score, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM ({_SCORED}) GROUP BY 1, 2),
c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY lang ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tp FROM g)
SELECT lang, round(sum(n*(tp + p/2.0::DOUBLE)) / nullif(sum(p)*sum(n), 0), 6) AS auc FROM c GROUP BY lang
""")
def auc_by_language(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.area_under_roc(_scored(spark, d), ["lang"], F.col("positive"), F.col("score")))


@query(f"""
WITH s AS ({_SCORED}), t AS (SELECT count(*) FILTER (positive) AS pp, count(*) FILTER (NOT positive) AS nn FROM s),
cuts AS (SELECT DISTINCT score FROM s UNION ALL SELECT NULL)
SELECT round(c.score, 6) AS score, round(count(s.doc_id) FILTER (NOT positive)/any_value(nn), 6) AS fpr, round(count(s.doc_id) FILTER (positive)/any_value(pp), 6) AS tpr
FROM cuts c CROSS JOIN t LEFT JOIN s ON s.score >= c.score GROUP BY c.score
""")
def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.roc_curve(_scored(spark, d), [], F.col("positive"), F.col("score")))


@query(f"""
WITH s AS ({_SCORED}), r AS (
  SELECT score, doc_id AS tie, count(*) FILTER (positive) OVER w AS hits, count(*) OVER w AS taken, count(*) FILTER (positive) OVER () AS pp
  FROM s WINDOW w AS (ORDER BY score DESC, doc_id % 64, doc_id ROWS UNBOUNDED PRECEDING))
SELECT round(score, 6) AS score, tie, round(hits/taken, 6) AS precision, round(hits/pp, 6) AS recall FROM r UNION ALL SELECT NULL, NULL, 1.0, 0.0
""")
def precision_recall_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.precision_recall_curve(_scored(spark, d), [], F.col("positive"), F.col("score"), F.col("doc_id")))


_GUESS = "SELECT lang AS truth, CASE WHEN n_chars % 7 = 0 THEN 'de' WHEN n_chars % 11 = 0 THEN 'es' ELSE lang END AS predicted FROM documents"


def _guess(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, d, "documents").select(F.col("lang").alias("truth"), F.when(n % 7 == 0, "de").when(n % 11 == 0, "es").otherwise(F.col("lang")).alias("predicted"))


@query(f"SELECT truth, predicted, count(*) AS n FROM ({_GUESS}) GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion_matrix(_guess(spark, d), "truth", "predicted")


_PER_LABEL = f"""
WITH g AS ({_GUESS}), l AS (SELECT DISTINCT truth AS label FROM g),
c AS (SELECT label, (SELECT count(*) FROM g WHERE truth = label) AS t, (SELECT count(*) FROM g WHERE predicted = label) AS p, (SELECT count(*) FROM g WHERE truth = label AND predicted = label) AS h FROM l),
m AS (SELECT label, t, h/nullif(p, 0) AS precision, h/nullif(t, 0) AS recall, 2*(h/nullif(p,0))*(h/nullif(t,0))/((h/nullif(p,0))+(h/nullif(t,0))) AS f1 FROM c)
"""


@query(_PER_LABEL + "SELECT label, t, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m")
def precision_recall_f1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.per_label(metrics.confusion_matrix(_guess(spark, d), "truth", "predicted")))


@query(_PER_LABEL + """SELECT round(sum(precision*t)/sum(t), 6) AS micro_precision, round(avg(precision), 6) AS macro_precision, round(sum(recall*t)/sum(t), 6) AS micro_recall,
round(avg(recall), 6) AS macro_recall, round(sum(f1*t)/sum(t), 6) AS micro_f1, round(avg(f1), 6) AS macro_f1, count(f1) AS labels FROM m""")
def micro_macro_averages(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.averages(metrics.per_label(metrics.confusion_matrix(_guess(spark, d), "truth", "predicted"))))


@query(f"""
SELECT least(floor(score*10), 9)::BIGINT AS bin, count(*) AS n, (least(floor(score*10), 9) + 0.5::DOUBLE)/10 AS center, round(avg(positive::INT), 6) AS empirical FROM ({_SCORED}) GROUP BY 1, 3 HAVING count(*) >= 5
""")
def calibration_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.calibration(_scored(spark, d), F.col("positive"), F.col("score"), 10, 5))


@query(f"""
WITH s AS (SELECT lang, positive, score*0.98 + 0.01 AS p FROM ({_SCORED}))
SELECT lang, round(avg(-ln(CASE WHEN positive THEN p ELSE 1 - p END)), 6) AS negative_log_probability FROM s GROUP BY 1
""")
def negative_log_probability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.negative_log_probability(_scored(spark, d), ["lang"], F.col("positive"), F.col("score") * 0.98 + 0.01))


_HT = "SELECT lang, CASE lang WHEN 'en' THEN 3 ELSE 1 END + n_chars % 13 AS en, CASE lang WHEN 'de' THEN 4 ELSE 1 END + n_chars % 11 AS de, CASE lang WHEN 'fr' THEN 5 ELSE 1 END + n_chars % 7 AS fr, CASE lang WHEN 'es' THEN 6 ELSE 1 END + n_chars % 5 AS es FROM documents"
_LANGS = {"en": (3, 13), "de": (4, 11), "fr": (5, 7), "es": (6, 5)}
_PAIRS = " UNION ALL ".join(f"SELECT lang, '{a}' AS a, '{b}' AS b, {a}/({a}+{b}) AS s FROM d" for a in _LANGS for b in _LANGS if a != b)


@query(f"""
WITH d AS ({_HT}), p AS (SELECT a || '|' || b AS pair, lang = a AS yes, s FROM ({_PAIRS}) WHERE lang IN (a, b)),
u AS (SELECT x.pair, sum(CASE WHEN x.s > y.s THEN 1.0 WHEN x.s = y.s THEN 0.5 ELSE 0.0 END)/count(*) AS auc
      FROM (SELECT * FROM p WHERE yes) x JOIN (SELECT * FROM p WHERE NOT yes) y USING (pair) GROUP BY 1)
SELECT round(sum(auc)/12, 6) AS m_measure FROM u
""")
def multiclass_auc(spark: SparkSession, d: str) -> DataFrame:
    n, lang = F.col("n_chars"), F.col("lang")
    score = {a: (F.when(lang == a, w).otherwise(1) + n % k).cast("double") for a, (w, k) in _LANGS.items()}
    return rounded(metrics.hand_till(table(spark, d, "documents").select("lang", "n_chars"), "lang", score))


_LISTS = "SELECT o_custkey AS usr, o_orderkey AS item, ((o_orderkey*31 + o_custkey*17) % 61)/4.0::DOUBLE AS gain FROM orders"


def _lists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("usr"), F.col("o_orderkey").alias("item"), (((F.col("o_orderkey") * 31 + F.col("o_custkey") * 17) % 61) / 4.0).alias("gain"))


def _ndcg(discount: str) -> str:
    r, b = discount.format("r"), discount.format("b")
    return f"""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY item) AS r FROM ({_LISTS})),
k AS (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY gain DESC, r) AS b FROM l)
SELECT usr, round(sum(gain*{r}), 6) AS dcg, round(sum(gain*{r})/nullif(sum(gain*{b}), 0), 6) AS ndcg FROM k GROUP BY usr
"""


@query(_ndcg("(1/log2({}+1.0))"))
def ndcg(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.ranked_gain(_lists(spark, d), "usr", F.col("gain"), [F.col("item")]))


@query(_ndcg("(1.0::DOUBLE/{})"))
def linear_ndcg(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.ranked_gain(_lists(spark, d), "usr", F.col("gain"), [F.col("item")], linear=True))


@query(f"""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY item) AS r FROM ({_LISTS})),
t AS (SELECT a.usr, a.r, a.gain, sum(least(a.gain, b.gain)) / a.r AS term FROM l a JOIN l b ON a.usr = b.usr AND b.r <= a.r GROUP BY 1, 2, 3)
SELECT usr, round(sum(term)/nullif(sum(gain), 0), 6) AS gap FROM t GROUP BY usr
""")
def graded_average_precision(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.graded_average_precision(_lists(spark, d), "usr", F.col("gain"), [F.col("item")]))


@query("""
SELECT l_shipmode, round(sum(a*b)/sqrt(sum(a*a)*sum(b*b)), 6) AS cosine, round(corr(a, b), 6) AS pearson, round(1/(1+sqrt(avg((a-b)**2))), 6) AS euclidean, round(1/(1+avg(abs(a-b))), 6) AS manhattan
FROM (SELECT l_linenumber AS l_shipmode, l_quantity::DOUBLE AS a, l_extendedprice/1000 AS b FROM lineitem) GROUP BY 1
""")
def similarities(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("l_shipmode", F.col("l_linenumber"))
    return rounded(metrics.similarities(li, ["l_shipmode"], F.col("l_quantity").cast("double"), F.col("l_extendedprice") / 1000))


# Recommender

_RATINGS = "SELECT o_custkey AS usr, l_partkey AS item, max(least(5, greatest(1, ceil(l_quantity/10.0))))::BIGINT AS rating FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2"


def _ratings(spark: SparkSession, d: str) -> DataFrame:
    return recommender.ratings(table(spark, d, "orders"), table(spark, d, "lineitem"))


@query(_RATINGS.replace("AS usr", 'AS "user"'))
def ratings(spark: SparkSession, d: str) -> DataFrame:
    return _ratings(spark, d)


_H = "((({}) * 2654435761) % 4294967296)"


@query(f"""
WITH r AS ({_RATINGS}), i AS (SELECT item, row_number() OVER (ORDER BY {_H.format("item+1")}, item) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT item FROM r)),
u AS (SELECT usr, row_number() OVER (ORDER BY {_H.format("usr+2")}, usr) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT usr FROM r)),
w AS (SELECT r.*, CASE WHEN i.p < round_even(i.n*0.1, 0) THEN 'test' WHEN i.p < round_even(i.n*0.15, 0) THEN 'out' ELSE 'warm' END AS fi,
  CASE WHEN u.p < round_even(u.n*0.05, 0) THEN 'test' WHEN u.p < round_even(u.n*0.55, 0) THEN 'train' WHEN u.p < round_even(u.n*0.65, 0) THEN 'out' ELSE 'warm' END AS fu FROM r JOIN i USING (item) JOIN u ON u.usr = r.usr),
k AS (SELECT *, row_number() OVER (PARTITION BY usr, fi ORDER BY {_H.format("item*7919+usr+3")}, item) AS place, count(*) OVER (PARTITION BY usr, fi) AS n FROM w),
f AS (SELECT usr AS "user", item, rating, CASE WHEN fi <> 'warm' THEN fi WHEN fu <> 'warm' THEN fu WHEN place <= greatest(1, floor(n*0.75::DOUBLE)) THEN 'train' ELSE 'test' END AS fold FROM k)
SELECT * FROM f WHERE fold <> 'out'
""")
def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    return recommender.split(_ratings(spark, d), 0.1, 0.05, 0.5, 0.75, 0.05, 0.1)


@query()
def histogram_negatives(spark: SparkSession, d: str) -> DataFrame:
    return recommender.histogram_negatives(_ratings(spark, d))


@query(f"""
WITH r AS ({_RATINGS}),
s AS (SELECT a.item, b.item AS other, count(*) AS common, 1/(1+avg(abs(a.rating-b.rating))) AS similarity FROM r a JOIN r b ON a.usr = b.usr AND a.item <> b.item GROUP BY 1, 2 HAVING count(*) >= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY similarity DESC, common DESC, other)::INT AS place FROM s)
SELECT item, other, common, round(similarity, 6) AS similarity, place FROM k WHERE place <= 5
""")
def related_items(spark: SparkSession, d: str) -> DataFrame:
    return rounded(recommender.related_items(_ratings(spark, d), 2, 5))


_BIAS = f"""
WITH r AS ({_RATINGS}), m AS (SELECT avg(rating) AS mean FROM r),
i AS (SELECT item, sum(rating - mean)/(count(*) + 5.0) AS ib FROM r, m GROUP BY item),
u AS (SELECT usr, sum(rating - mean - ib)/(count(*) + 5.0) AS ub FROM r JOIN i USING (item), m GROUP BY usr),
p AS (SELECT r.usr, r.item, r.rating, mean + ib + ub AS predicted FROM r JOIN i USING (item) JOIN u ON u.usr = r.usr, m)
"""


@query(_BIAS + """SELECT rating, round(avg((rating <> predicted)::INT::DOUBLE), 6) AS zero_one_error, round(avg((rating-predicted)**2), 6) AS squared_error,
round(sqrt(avg((rating-predicted)**2)), 6) AS rmse, round(avg(abs(rating-predicted)), 6) AS absolute_error FROM p GROUP BY rating""")
def rating_errors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.pointwise(recommender.biases(_ratings(spark, d), 5.0), ["rating"], F.col("rating"), F.col("predicted")))


@query(_BIAS + """SELECT round(sum(s)/sum(n), 6) AS over_pairs, round(avg(m), 6) AS over_users FROM (SELECT usr, avg(abs(rating-predicted)) AS m, sum(abs(rating-predicted)) AS s, count(*) AS n FROM p GROUP BY usr)""")
def per_user_errors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.per_user_first(recommender.biases(_ratings(spark, d), 5.0), "user", F.abs(F.col("rating") - F.col("predicted"))))


_DIST = "SELECT o_custkey AS usr, l_linenumber AS v, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY o_custkey) AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2"


@query(f"""
WITH d AS ({_DIST}), c AS (SELECT usr, e.v AS estimate, round(sum(p*abs(d.v - e.v)), 12) AS cost FROM d CROSS JOIN (SELECT unnest(range(1, 8))::INT AS v) e GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY cost, estimate) AS r FROM c)
SELECT usr, estimate, round(cost, 6) AS expected_loss FROM k WHERE r = 1
""")
def least_absolute_loss(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("usr"))
    n = o.join(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("usr", F.col("l_linenumber").alias("v")).agg(F.count("*").alias("n"))
    dist = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("usr")))
    return rounded(metrics.least_expected_loss(dist, "usr", "v", "p", list(range(1, 8)), "absolute"))


# Relational preparation


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 100")
def most_active_users(spark: SparkSession, d: str) -> DataFrame:
    return relational.most_active(table(spark, d, "orders"), "o_custkey", 100)


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def users_without_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_name").join(table(spark, d, "orders").where("o_totalprice > 450000").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def parts_in_large_lines(spark: SparkSession, d: str) -> DataFrame:
    large = table(spark, d, "lineitem").where(F.col("l_quantity") >= 49).select("l_partkey")
    return table(spark, d, "part").select("p_partkey", "p_brand").join(large, F.col("p_partkey") == F.col("l_partkey"), "left_semi")


@query("SELECT user_id FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1 HAVING count(DISTINCT event_type) = 3")
def users_with_all_types(spark: SparkSession, d: str) -> DataFrame:
    return relational.having_all(table(spark, d, "events"), "user_id", "event_type", ["click", "view", "purchase"])


@query("SELECT p_partkey, 'p_brand' AS feature, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part UNION ALL SELECT p_partkey, 'p_size', p_size::VARCHAR FROM part")
def item_features(spark: SparkSession, d: str) -> DataFrame:
    return relational.unpivoted(table(spark, d, "part"), ["p_partkey"], ["p_brand", "p_type", "p_size"])


@query("""
SELECT user_id, session, count(*) AS n FROM (
  SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM (
    SELECT user_id, ts, event_id, coalesce(((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)))/1e6 > 3600)::INT, 0) AS s FROM events)) GROUP BY 1, 2
""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return relational.sessions(table(spark, d, "events"), "user_id", "ts", "event_id", 3600).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("""
WITH a AS (SELECT conv_id, turn AS ask, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS until FROM conversations WHERE role = 'user')
SELECT a.conv_id, ask, count(*) AS replies, sum(length(text))::BIGINT AS chars FROM a JOIN conversations t ON a.conv_id = t.conv_id AND t.turn > ask AND (until IS NULL OR t.turn < until) GROUP BY 1, 2
""")
def replies_between_questions(spark: SparkSession, d: str) -> DataFrame:
    return relational.next_reply(table(spark, d, "conversations"))


@query("SELECT c_custkey, ceil((c_acctbal/1000 + 10.0)/2)::INT AS rating FROM customer WHERE c_custkey % 5 = 1")
def rescaled_ratings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where(F.col("c_custkey") % 5 == 1).select("c_custkey", relational.rescaled(F.col("c_acctbal") / 1000).alias("rating"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY (o_orderkey * 2654435761) % 4294967296, o_orderkey LIMIT 200")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return relational.hash_sample(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey"), 200)


@query("SELECT l_partkey AS k FROM lineitem UNION SELECT p_partkey FROM part")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")).union(table(spark, d, "part").select(F.col("p_partkey").alias("k"))).distinct()


@query("SELECT c_custkey, coalesce(s, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def update_from_join(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return relational.updated(table(spark, d, "customer").select("c_custkey", "c_acctbal"), new, "c_custkey", "c_acctbal")


# Strings, matrices, learners, streams, declared models


@query("SELECT lang, source, round(ln(n / sum(n) OVER (PARTITION BY lang)), 6) AS logp FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2)")
def string_distributions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(strings.support(table(spark, d, "documents").select("lang", "source"), "lang", "source"))


@query("""
WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), l AS (SELECT lang, source, ln(n / sum(n) OVER (PARTITION BY lang)) AS logp FROM c),
j AS (SELECT a.lang AS a, b.lang AS b, a.source, a.logp + b.logp AS logp FROM l a JOIN l b ON a.source = b.source AND a.lang < b.lang)
SELECT a, b, source, round(logp - ln(sum(exp(logp)) OVER (PARTITION BY a, b)), 6) AS logp FROM j
""")
def string_product(spark: SparkSession, d: str) -> DataFrame:
    return rounded(strings.products(strings.support(table(spark, d, "documents").select("lang", "source"), "lang", "source"), "lang", "source"))


@query("""
WITH c AS (SELECT p_name[i:i] AS first, p_name[i+1:i+1] AS second, count(*) AS n FROM (SELECT p_name, unnest(range(1, length(p_name))) AS i FROM part) GROUP BY 1, 2)
SELECT first, second, n, round(n / sum(n) OVER (PARTITION BY first), 6) AS p FROM c
""")
def character_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return rounded(strings.character_bigrams(table(spark, d, "part"), "p_name"))


@query("""
WITH m AS (SELECT label, vec_id, unnest(range(0, len(embedding)))::INT AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT a.label, a.i, b.i AS j, round(covar_pop(a.v, b.v), 6) + 0.0 AS covariance FROM m a JOIN m b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2, 3
""")
def vector_covariance(spark: SparkSession, d: str) -> DataFrame:
    c = linear_algebra.covariances(table(spark, d, "embeddings"), "label", "embedding")
    return c.withColumn("covariance", F.round("covariance", 6) + 0.0)  # no negative zero


@query("""
WITH m AS (SELECT vec_id AS i, unnest(range(0, len(embedding)))::INT AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT a.j AS i, b.j AS j, round(sum(a.v*b.v), 4) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY 1, 2
""")
def matrix_product(spark: SparkSession, d: str) -> DataFrame:
    return rounded(linear_algebra.gram(table(spark, d, "embeddings"), "embedding"), 4)


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS norm2 FROM embeddings")
def inner_products(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return rounded(table(spark, d, "embeddings").select("vec_id", linear_algebra.dot(e, e).alias("norm2")), 4)


@query()
def gaussian_process_daily(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", (F.hour("ts") / 6.0).alias("x"), (F.col("value") / 100).alias("y"))
    return linear_algebra.gaussian_process(e, "event_type", "x", "y", [0.5, 1.5, 2.5], 0.1)


_VOTES = "SELECT doc_id AS task, w AS worker, CASE WHEN (doc_id*7 + w*13) % (w + 3) = 0 THEN 1 - toxic ELSE toxic END AS label FROM labels CROSS JOIN (SELECT unnest(range(0, 5)) AS w)"


def _votes(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "labels").select("doc_id", "toxic", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("w"))
    wrong = (F.col("doc_id") * 7 + F.col("w") * 13) % (F.col("w") + 3) == 0
    return each.select(F.col("doc_id").alias("task"), F.col("w").alias("worker"), F.when(wrong, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("label"))


@query(f"""
WITH v AS ({_VOTES}), b AS (SELECT task, avg(label) AS p FROM v GROUP BY 1),
s AS (SELECT worker, (sum(CASE WHEN label = 1 THEN p ELSE 1 - p END) + 1.0)/(count(*) + 2.0) AS a FROM v JOIN b USING (task) GROUP BY 1)
SELECT task, round(1/(1+exp(-sum(CASE WHEN label = 1 THEN ln(a/(1-a)) ELSE ln((1-a)/a) END))), 6) AS p FROM v JOIN s USING (worker) GROUP BY 1
""")
def crowd_labels(spark: SparkSession, d: str) -> DataFrame:
    votes = _votes(spark, d)
    return rounded(crowd.sweep(votes, crowd.majority(votes)))


@query()
def probit_classifier(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 25.0 - 1.0).alias("q"), (F.col("l_discount") * 20.0 - 1.0).alias("d"), (F.col("l_extendedprice") > 40000).cast("int").alias("y"))
    weights = classifier.train(li, ["q", "d"], "y")
    return classifier.predict(li, weights).groupBy("y").agg(F.count("*").alias("n"), F.round(F.avg("p"), 3).alias("p"))


@query("""
SELECT user_id, n, round((50.0/100 + s/25.0)/(1/100.0::DOUBLE + n/25.0::DOUBLE), 6) AS mean, round(1/(1/100.0::DOUBLE + n/25.0::DOUBLE), 6) AS variance FROM (SELECT user_id, count(value) AS n, sum(value) AS s FROM events GROUP BY 1)
""")
def running_posterior(spark: SparkSession, d: str) -> DataFrame:
    return rounded(posterior.posterior(posterior.statistics(table(spark, d, "events"), "user_id", "value"), "user_id", 50.0, 100.0, 25.0))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, (count(*) + 1.0::DOUBLE)/2 AS rate FROM events GROUP BY 1, 2")
def windowed_rates(spark: SparkSession, d: str) -> DataFrame:
    return posterior.windowed_rate(table(spark, d, "events"), "ts", "event_type", "1 day", "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
WITH x AS (SELECT l_returnflag AS f, l_linestatus AS s, l_quantity/10.0::DOUBLE AS y FROM lineitem),
f1 AS (SELECT f, (sum(y)/4.0)/(1 + count(*)/4.0) AS m FROM x GROUP BY f), s1 AS (SELECT s, (sum(y - m)/4.0)/(1 + count(*)/4.0) AS m FROM x JOIN f1 USING (f) GROUP BY s)
SELECT f AS l_returnflag, round((sum(y - s1.m)/4.0)/(1 + count(*)/4.0), 6) AS mean, round(1/(1 + count(*)/4.0), 9) AS variance FROM x JOIN s1 USING (s) GROUP BY f
""")
def declared_sum_model(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_quantity") / 10.0).alias("y"))
    model = SumModel("y", 4.0).gaussian("flag", "l_returnflag").gaussian("status", "l_linestatus")
    got = model.posteriors(li, sweeps=2)["flag"]
    return got.select("l_returnflag", F.round("mean", 6).alias("mean"), F.round("variance", 9).alias("variance"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
