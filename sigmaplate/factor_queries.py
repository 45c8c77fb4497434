"""Registered queries of the core factors' messages, with SQL written from the equations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalar, special
from .operators import factor_messages as fm
from .operators import factors
from .workload import query, rounded, table


def sql_cdf(x: str) -> str:
    """The normal distribution function by the series of positive terms of erf, which is 1 from 9 on."""
    y = f"least(abs({x}), 9.0)"
    return f"(0.5 + 0.5*sign({x})*list_sum(list_transform(range(0, 140), lambda n: exp((2*n+1)*ln(greatest({y}, 1e-300)/sqrt(2.0)) - {y}*{y}/2 - lgamma(n+1.5)))))"


def sql_pdf(x: str) -> str:
    return f"(exp(-({x})*({x})/2)/sqrt(2*pi()))"


def sql_digamma(x: str) -> str:
    return f"(ln({x}+40) - 1/(2*({x}+40)) - 1/(12*({x}+40)**2) + 1/(120*({x}+40)**4) - list_sum(list_transform(range(0, 40), lambda k: 1/({x}+k))))"


def sql_trigamma(x: str) -> str:
    return f"(1/({x}+40) + 1/(2*({x}+40)**2) + 1/(6*({x}+40)**3) - 1/(30*({x}+40)**5) + list_sum(list_transform(range(0, 40), lambda k: 1/(({x}+k)*({x}+k)))))"


def sql_logistic_mean(f: str, m: str, v: str) -> str:
    """Mean of an expression of z (in braces) under a Gaussian, by the trapezoid rule over 12 deviations either side."""
    point = f"({m} + sqrt({v})*(k/25.0))"
    return f"(list_sum(list_transform(range(-300, 301), lambda k: exp(-(k/25.0)*(k/25.0)/2)*({f.format(point)}))) / list_sum(list_transform(range(-300, 301), lambda k: exp(-(k/25.0)*(k/25.0)/2))))"


_LINES = "SELECT l_orderkey, l_linenumber, l_quantity/9.8713::DOUBLE AS a, 0.51231::DOUBLE + l_tax*9.7171::DOUBLE AS va, l_extendedprice/19937.31::DOUBLE AS b, 1.01737::DOUBLE + l_discount*10.3391::DOUBLE AS vb FROM lineitem"


def _lines(spark: SparkSession, d: str) -> tuple[DataFrame, Column, Column, Column, Column]:
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") / 9.8713).alias("a"), (F.col("l_tax") * 9.7171 + 0.51231).alias("va"),
        (F.col("l_extendedprice") / 19937.31).alias("b"), (F.col("l_discount") * 10.3391 + 1.01737).alias("vb"),
    )
    return li, F.col("a"), F.col("va"), F.col("b"), F.col("vb")


_KEYS = ["l_orderkey", "l_linenumber"]


def _shown(df: DataFrame, **columns) -> DataFrame:
    return rounded(df.select(*_KEYS, *[c.alias(n) for n, c in columns.items()]))


@query(f"""
SELECT l_orderkey, l_linenumber, round(a/(va+2.0), 6) AS tau, round(1/(va+2.0), 6) AS prec, round(a*1.5, 6) AS vmp_tau, round((va+(a-b)*(a-b)+vb)/2, 6) AS vmp_rate,
       round(-0.5*(ln(2*pi()*(va+vb)) + (a-b)*(a-b)/(va+vb)), 6) AS log_average, round(0.5*({sql_digamma("3.0")} - ln(2.0) - ln(2*pi()) - 1.5*(va+(a-b)*(a-b)+vb)), 6) AS average_log FROM ({_LINES})
""")
def gaussian_factor_messages(spark: SparkSession, d: str) -> DataFrame:
    li, a, va, b, vb = _lines(spark, d)
    to = fm.gaussian_to_either(a, va, F.lit(2.0))
    return _shown(
        li, tau=to["tau"], prec=to["prec"], vmp_tau=fm.gaussian_variational(a, F.lit(1.5))["tau"], vmp_rate=fm.precision_variational(a, va, b, vb)["rate"],
        log_average=fm.gaussian_log_average(a, va, b, vb), average_log=fm.gaussian_average_log(a, va, b, vb, F.lit(3.0), F.lit(2.0)),
    )


@query(f"""
SELECT l_orderkey, l_linenumber, round(a+b, 6) AS sum_mean, round(va+vb, 6) AS sum_variance, round((9.0-b)/(4.0+vb), 6) AS back_tau, round(1/(4.0+vb), 6) AS back_prec,
       round((9.0+b)/(4.0+vb), 6) AS difference_back_tau, round(0.7*a/va + 0.3*b/vb, 6) AS damped_tau, round(0.7/va + 0.3/vb, 6) AS damped_prec, round(0.5*a/va, 6) AS power_tau FROM ({_LINES})
""")
def sum_factor_messages(spark: SparkSession, d: str) -> DataFrame:
    li, a, va, b, vb = _lines(spark, d)
    both = factors.linear_moments([(1.0, a, va), (1.0, b, vb)])
    back, minus = fm.difference_back(F.lit(9.0), F.lit(4.0), b, vb), fm.difference_back(F.lit(9.0), F.lit(4.0), -b, vb)
    damp = fm.damped(fm.natural(a, va), fm.natural(b, vb), 0.3)
    return _shown(
        li, sum_mean=both["mean"], sum_variance=both["variance"], back_tau=back["tau"], back_prec=back["prec"], difference_back_tau=minus["tau"],
        damped_tau=damp["tau"], damped_prec=damp["prec"], power_tau=fm.powered(fm.natural(a, va), F.lit(0.5))["tau"],
    )


@query(f"""
SELECT l_orderkey, l_linenumber, round(a*b, 6) AS mean, round((va+a*a)*(vb+b*b) - a*a*b*b, 6) AS variance, round(2.0*b, 6) AS back_tau, round(0.8*(vb+b*b), 6) AS back_prec,
       round(a*exp(b/10+vb/20), 6) AS exp_mean, round((va+a*a)*exp(b/5+vb/5) - (a*exp(b/10+vb/20))**2, 4) AS exp_variance, round(a/4, 6) AS ratio_mean, round(va/16, 6) AS ratio_variance FROM ({_LINES})
""")
def product_factor_messages(spark: SparkSession, d: str) -> DataFrame:
    li, a, va, b, vb = _lines(spark, d)
    p, back, e, r = fm.product_moments(a, va, b, vb), fm.product_back(F.lit(2.0), F.lit(0.8), b, vb), fm.product_exp_moments(a, va, b / 10.0, vb / 10.0), fm.ratio_moments(a, va, F.lit(4.0))
    shown = _shown(
        li, mean=p["mean"], variance=p["variance"], back_tau=back["tau"], back_prec=back["prec"], exp_mean=e["mean"],
        exp_variance=F.round(e["variance"], 4), ratio_mean=r["mean"], ratio_variance=r["variance"],
    )
    return shown


_Z = f"SELECT *, (a-b)/3/sqrt(va) AS z, (a-b)/3 AS m FROM ({_LINES})"
_POS = f"""
SELECT *, {sql_cdf("z")} AS cdf, {sql_pdf("z")} AS pdf FROM ({_Z})
"""


@query(f"""
SELECT l_orderkey, l_linenumber, round(ln(cdf) - ln(1-cdf), 5) AS log_odds, round(m + sqrt(va)*pdf/cdf, 5) AS mean, round(va - va*(pdf/cdf)*(pdf/cdf + z), 5) AS variance,
       round(m + sqrt(va)*pdf*0.6/(0.2+0.6*cdf), 5) AS soft_mean, round(va - va*(pdf*0.6/(0.2+0.6*cdf))*(pdf*0.6/(0.2+0.6*cdf) + z), 5) AS soft_variance FROM ({_POS})
""")
def positive_factor_messages(spark: SparkSession, d: str) -> DataFrame:
    li, a, va, b, _ = _lines(spark, d)
    m = (a - b) / 3.0
    sure, soft = fm.positive_posterior(m, va), fm.positive_posterior(m, va, F.lit(0.8))
    shown = li.select(
        *_KEYS, fm.positive_log_odds(m, va).alias("log_odds"), sure["mean"].alias("mean"), sure["variance"].alias("variance"),
        soft["mean"].alias("soft_mean"), soft["variance"].alias("soft_variance"),
    )
    return rounded(shown, 5)


_GREATER = f"""
SELECT *, {sql_cdf("z")} AS cdf, {sql_pdf("z")} AS pdf, sqrt(va+vb) AS s FROM (SELECT *, (a-b)/sqrt(va+vb) AS z FROM ({_LINES}))
"""


@query(f"""
SELECT l_orderkey, l_linenumber, round(ln(cdf), 5) AS log_evidence, round(a + va/s*pdf/cdf, 5) AS mean_a, round(va - va*va/(va+vb)*(pdf/cdf)*(pdf/cdf+z), 5) AS variance_a,
       round(b - vb/s*pdf/cdf, 5) AS mean_b, round(vb - vb*vb/(va+vb)*(pdf/cdf)*(pdf/cdf+z), 5) AS variance_b FROM ({_GREATER})
""")
def greater_factor_messages(spark: SparkSession, d: str) -> DataFrame:
    li, a, va, b, vb = _lines(spark, d)
    return rounded(li.select(*_KEYS, fm.greater_posteriors(a, va, b, vb).alias("g")).select(*_KEYS, "g.*"), 5)


@query(f"""
WITH t AS (SELECT *, (3.0*va + a*2.0)/(va+2.0) AS m1, va*2.0/(va+2.0) AS v1, -0.5*(ln(2*pi()*(va+2.0)) + (a-3.0)**2/(va+2.0)) AS l1,
                     (3.0*vb + b*2.0)/(vb+2.0) AS m2, vb*2.0/(vb+2.0) AS v2, -0.5*(ln(2*pi()*(vb+2.0)) + (b-3.0)**2/(vb+2.0)) AS l2 FROM ({_LINES})),
u AS (SELECT *, (m1-b)/sqrt(v1+vb) AS za, (m2-a)/sqrt(v2+va) AS zb FROM t),
c AS (SELECT *, {sql_cdf("za")} AS ca, {sql_cdf("zb")} AS cb FROM u),
p AS (SELECT *, {sql_pdf("za")}/ca AS ra, {sql_pdf("zb")}/cb AS rb, exp(l1)*ca/(exp(l1)*ca + exp(l2)*cb) AS w FROM c),
q AS (SELECT *, m1 + v1*ra/sqrt(v1+vb) AS e1, v1 - v1*v1*ra*(ra+za)/(v1+vb) AS s1, a - va*rb/sqrt(v2+va) AS e2, va - va*va*rb*(rb+zb)/(v2+va) AS s2 FROM p)
SELECT l_orderkey, l_linenumber, round(w*e1 + (1-w)*e2, 5) AS mean, round(w*(s1+e1*e1) + (1-w)*(s2+e2*e2) - (w*e1 + (1-w)*e2)**2, 5) AS variance FROM q
""")
def max_factor_messages(spark: SparkSession, d: str) -> DataFrame:
    li, a, va, b, vb = _lines(spark, d)
    return rounded(li.select(*_KEYS, fm.max_back(F.lit(3.0), F.lit(2.0), a, va, b, vb).alias("g")).select(*_KEYS, "g.*"), 5)


@query(f"""
SELECT l_orderkey, l_linenumber, round((a*a)/va, 6) AS moment_shape, round(1/(exp(va/10)-1), 5) AS exp_shape, round(exp(-a/10-va/20)/(exp(va/10)-1), 5) AS exp_rate,
       round({sql_digamma("(a+0.5)")} - ln(vb), 6) AS log_mean, round({sql_trigamma("(a+0.5)")}, 6) AS log_variance, round(exp(lgamma(a+1.25) - lgamma(a+0.5) - 0.75*ln(vb)), 6) AS power_mean,
       round(a + 1, 6) AS rate_shape FROM ({_LINES})
""")
def exp_log_messages(spark: SparkSession, d: str) -> DataFrame:
    li, a, va, _, vb = _lines(spark, d)
    e, g = fm.exp_moments(a / 10.0, va / 10.0), fm.log_moments(a + 0.5, vb)
    shown = _shown(
        li, moment_shape=fm.gamma_from_moments(a, va)["shape"], exp_shape=F.round(e["shape"], 5), exp_rate=F.round(e["rate"], 5), log_mean=g["mean"], log_variance=g["variance"],
        power_mean=fm.power_mean(a + 0.5, vb, F.lit(0.75)), rate_shape=fm.gamma_rate_back(a, vb)["shape"],
    )
    return shown


@query(f"""
WITH g AS (SELECT p_partkey, p_size/10.0::DOUBLE - 2.5 AS m, 0.2 + (p_partkey % 7)/3.0::DOUBLE AS v FROM part),
e AS (SELECT *, {sql_logistic_mean("1/(1+exp(-{0}))", "m", "v")} AS f, {sql_logistic_mean("(1/(1+exp(-{0})))*(1/(1+exp({0})))", "m", "v")} AS d,
      {sql_logistic_mean("ln(1+exp({0}))", "m", "v")} AS s FROM g)
SELECT p_partkey, round(f, 6) AS probability, round(d, 6) AS derivative, round(s, 6) AS softplus, round(f*(f*(1-f)/(f-d-f*f) - 1), 4) AS true_count FROM e
""")
def logistic_gaussian_messages(spark: SparkSession, d: str) -> DataFrame:
    m, v = F.col("p_size") / 10.0 - 2.5, (F.col("p_partkey") % 7) / 3.0 + 0.2
    p = table(spark, d, "part").select("p_partkey", m.alias("m"), v.alias("v"))
    m, v = F.col("m"), F.col("v")
    return rounded(p.select(
        "p_partkey", fm.bernoulli_from_log_odds(m, v).alias("probability"), special.logistic_gaussian_derivative(m, v).alias("derivative"),
        special.log1p_exp_gaussian(m, v).alias("softplus"), F.round(fm.logistic_beta(m, v)["true_count"], 4).alias("true_count"),
    ))


_GATES = """
SELECT event_id, value AS x, [0.5, 0.3, 0.2] AS w, [value/50.37, value/40.11, value/30.73] AS m, [1.0, 2.0, 0.5] AS v FROM events
"""


@query(f"""
WITH g AS ({_GATES}), c AS (
  SELECT event_id, unnest(range(1, 4)) AS k, w, m, v FROM g),
t AS (SELECT event_id, ln(w[k]) - 0.5*(ln(2*pi()*(v[k]+3.0)) + (m[k]-1.0)**2/(v[k]+3.0)) AS l, (m[k]*3.0 + v[k])/(v[k]+3.0) AS mm, v[k]*3.0/(v[k]+3.0) AS vv, w[k] AS ww, m[k]/v[k] AS tau, 1/v[k] AS prec FROM c),
s AS (SELECT *, exp(l)/sum(exp(l)) OVER (PARTITION BY event_id) AS r FROM t)
SELECT event_id, round(sum(r*mm), 6) AS mean, round(sum(r*(vv+mm*mm)) - sum(r*mm)**2, 6) AS variance, round(sum(ww*tau), 6) AS power_tau, round(sum(ww*prec), 6) AS power_prec, round(max(r), 6) AS top FROM s GROUP BY event_id
""")
def gate_messages(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("value")
    weights, mean, variance = F.array(*map(F.lit, (0.5, 0.3, 0.2))), F.array(x / 50.37, x / 40.11, x / 30.73), F.array(*map(F.lit, (1.0, 2.0, 0.5)))
    e = table(spark, d, "events").select("event_id", weights.alias("w"), mean.alias("m"), variance.alias("v"))
    left = fm.gate_enter_back(F.col("w"), F.col("m"), F.col("v"), F.lit(1.0), F.lit(3.0))
    tau, prec = F.zip_with("m", "v", lambda m, v: m / v), F.transform("v", lambda v: F.lit(1.0) / v)
    power = fm.gate_power(F.col("w"), tau, prec)
    evidence = F.transform(F.arrays_zip("w", "m", "v"), lambda t: F.log(t["w"]) + fm.gaussian_log_average(t["m"], t["v"], F.lit(1.0), F.lit(3.0)))
    got = e.select("event_id", left.alias("left"), power.alias("p"), F.array_max(fm.gate_selector_back(evidence)).alias("top"))
    return rounded(got.select("event_id", "left.mean", "left.variance", F.col("p.tau").alias("power_tau"), F.col("p.prec").alias("power_prec"), "top"))


@query("""
SELECT event_id, round(ln(p) - ln(1-p), 6) AS log_odds, round(1-p, 6) AS complement, round(0.9*p + 0.1*(1-p), 6) AS equal_back, round((1-p)*(1-q)*(1-r), 6) AS none, round(p*(1-q)*(1-r) + q*(1-p)*(1-r) + r*(1-p)*(1-q), 6) AS one,
       round(p*q*r, 6) AS all_true, round(0.5*p + 0.3*q + 0.2*r, 6) AS mixed, round((0.7*p+0.3*(1-p))/((0.7*p+0.3*(1-p)) + (0.7*q+0.3*(1-q)) + (0.7*r+0.3*(1-r))), 6) AS first_case
FROM (SELECT event_id, 1/(1+exp(-value/60.7)) AS p, 0.3 AS q, 0.05 + (event_id % 9)/10.0::DOUBLE AS r FROM events)
""")
def logic_factor_messages(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", scalar.logistic(F.col("value") / 60.7).alias("p"), F.lit(0.3).alias("q"), ((F.col("event_id") % 9) / 10.0 + 0.05).alias("r"))
    ps = F.array("p", "q", "r")
    cases = fm.gate_cases(F.col("p"))
    each = e.select("event_id", "p", ps.alias("ps"), fm.count_true(ps).alias("n"), fm.gate_cases_back(cases).alias("log_odds"))
    weights = F.array(*map(F.lit, (0.5, 0.3, 0.2)))
    return rounded(each.select(
        "event_id", "log_odds", fm.not_back(F.col("p")).alias("complement"), fm.equal_back(F.lit(0.9), F.col("p")).alias("equal_back"), F.col("n")[0].alias("none"), F.col("n")[1].alias("one"),
        F.col("n")[3].alias("all_true"), fm.bernoulli_from_discrete(weights, F.col("ps")).alias("mixed"), fm.discrete_from_bernoulli(F.lit(0.7), F.col("ps"))[0].alias("first_case"),
    ))


_COUNTS = "SELECT user_id, [count(*) FILTER (event_id % 3 = 0), count(*) FILTER (event_id % 3 = 1), count(*) FILTER (event_id % 3 = 2)] AS c FROM events GROUP BY 1"
_DG = [sql_digamma(f"(c[{k}]+1.0)") for k in (1, 2, 3)]


@query(f"""
WITH e AS (SELECT user_id, c, list_sum(c) AS n FROM ({_COUNTS}))
SELECT user_id, round((c[1]+1.0)/(n+3), 6) AS mean, round(exp({_DG[0]})/(exp({_DG[0]})+exp({_DG[1]})+exp({_DG[2]})), 6) AS variational,
       round(lgamma(n+1.0) - lgamma(c[1]+1.0) - lgamma(n-c[1]+1.0) + c[1]*ln(0.3) + (n-c[1])*ln(0.7), 4) AS binomial, round((c[1]+1.0)*(n-c[1]+2.0)/((n+3.0)**2*(n+4.0)), 8) AS variance,
       round(lgamma(n+1.0) - lgamma(c[1]+1.0) - lgamma(c[2]+1.0) - lgamma(c[3]+1.0) + c[1]*ln(0.5) + c[2]*ln(0.3) + c[3]*ln(0.2), 4) AS multinomial FROM e
""")
def dirichlet_factor_messages(spark: SparkSession, d: str) -> DataFrame:
    n = [F.sum((F.col("event_id") % 3 == k).cast("double")) for k in range(3)]
    e = table(spark, d, "events").groupBy("user_id").agg(F.array(*n).alias("c")).withColumn("n", F.col("c")[0] + F.col("c")[1] + F.col("c")[2])
    pseudo = F.transform("c", lambda c: c + 1.0)
    mean = (F.col("c")[0] + 1.0) / (F.col("n") + 3.0)
    return e.select(
        "user_id", F.round(fm.dirichlet_mean(pseudo)[0], 6).alias("mean"), F.round(fm.dirichlet_variational(pseudo)[0], 6).alias("variational"),
        F.round(fm.binomial_log_probability(F.col("n"), F.col("c")[0], F.lit(0.3)), 4).alias("binomial"),
        F.round(fm.beta_from_mean_and_total(mean, F.col("n") + 3.0)["variance"], 8).alias("variance"),
        F.round(fm.multinomial_log_probability(F.col("c"), F.array(*map(F.lit, (0.5, 0.3, 0.2)))), 4).alias("multinomial"),
    )


_SCORES = "SELECT event_id, [value/20, (event_id % 11)/3.0::DOUBLE, (event_id % 5)/1.0::DOUBLE, 1.0] AS s FROM events"


@query(f"""
WITH e AS (SELECT event_id, s, unnest(range(0, 4)) AS j FROM ({_SCORES}))
SELECT event_id, j, round(list_max([s[i+1] - CASE WHEN i = j THEN 0 ELSE 0.8 END for i in range(0, 4)]), 6) AS potts, round(list_max([s[i+1] - abs(i-j)*0.8 for i in range(0, 4)]), 6) AS linear,
       round(list_max([s[i+1] - least(abs(i-j)*0.8, 1.2) for i in range(0, 4)]), 6) AS truncated, round(list_sum(s) - s[j+1], 6) AS others_sum, round(list_max([s[i+1] for i in range(0, 4) if i <> j]), 6) AS others_max FROM e
""")
def potential_messages(spark: SparkSession, d: str) -> DataFrame:
    s = F.array(F.col("value") / 20.0, (F.col("event_id") % 11) / 3.0, (F.col("event_id") % 5) / 1.0, F.lit(1.0))
    e = table(spark, d, "events").select("event_id", s.alias("s"))
    got = {
        "potts": fm.best_under_penalty(F.col("s"), fm.potts(0.8)), "linear": fm.best_under_penalty(F.col("s"), fm.linear(0.8)),
        "truncated": fm.best_under_penalty(F.col("s"), fm.linear_truncated(0.8, 1.2)), "others_sum": fm.sum_except(F.col("s")), "others_max": fm.max_of_others(F.col("s")),
    }
    each = e.select("event_id", F.posexplode(F.arrays_zip(*[c.alias(n) for n, c in got.items()])).alias("j", "g"))
    return rounded(each.select("event_id", F.col("j").cast("long").alias("j"), "g.*"))


@query("""
WITH f AS (SELECT l_orderkey, l_linenumber, p_retailprice/1000 AS x, l_quantity::DOUBLE AS q, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_partkey, count(*) AS uses, round(sum(q/(1.0+l_linenumber)), 6) AS tau, round(sum(1/(1.0+l_linenumber)), 6) AS prec, round(max(x), 6) AS item FROM f GROUP BY 1
""")
def gather_messages(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_retailprice") / 1000).alias("x"))
    uses = fm.get_items(items, table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), "l_partkey")
    v = F.col("l_linenumber") + 1.0
    to = uses.select("l_partkey", "x", (F.col("l_quantity") / v).alias("tau"), (F.lit(1.0) / v).alias("prec"), F.lit(1).cast("long").alias("uses"))
    back = fm.get_items_back(to, "l_partkey", ["tau", "prec", "uses"])
    return rounded(fm.get_items(items, back, "l_partkey").select("l_partkey", "uses", "tau", "prec", F.col("x").alias("item")))


@query("""
SELECT vec_id, round(list_sum(embedding[1:5])::DOUBLE, 4) AS head, round(list_sum(embedding[6:])::DOUBLE, 4) AS tail, len(embedding[6:]) AS rest, round(list_sum(list_concat(embedding[6:], embedding[1:5]))::DOUBLE, 4) AS swapped FROM embeddings
""")
def array_splits(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    parts = e.select("vec_id", fm.split(F.col("e"), F.lit(5)).alias("s"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    head, tail = F.col("s")["head"], F.col("s")["tail"]
    return rounded(parts.select("vec_id", total(head).alias("head"), total(tail).alias("tail"), F.size(tail).cast("long").alias("rest"), total(F.concat(tail, head)).alias("swapped")), 4)


@query("SELECT o_orderkey % 100 AS place, o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")
def array_subarray(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("place"), "o_orderkey", "o_totalprice")
    return fm.subarray(o, "place", F.lit(100), F.lit(100))


@query("SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY 1) ON o_custkey = c_custkey")
def sparse_counts(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders").where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return fm.sparse_list(table(spark, d, "customer").select("c_custkey"), own, "c_custkey", "n", 0)


@query("""
WITH s AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice/1000) AS my, var_pop(l_quantity) AS xx, var_pop(l_extendedprice/1000) AS yy, covar_pop(l_quantity, l_extendedprice/1000) AS xy FROM lineitem GROUP BY 1),
p AS (SELECT *, n+4.0 AS dof, 1 + n*xx + n/(n+1.0)*mx*mx AS s11, n*xy + n/(n+1.0)*mx*my AS s12, 1 + n*yy + n/(n+1.0)*my*my AS s22 FROM s)
SELECT l_returnflag, round(n*mx/(n+1.0), 6) AS mean_x, round(n*my/(n+1.0), 6) AS mean_y, round(dof*s22/(s11*s22-s12*s12), 8) AS precision_xx, round(-dof*s12/(s11*s22-s12*s12), 8) AS precision_xy, round(ln(s11*s22-s12*s12), 6) AS log_det FROM p
""")
def vector_gaussian_wishart(spark: SparkSession, d: str) -> DataFrame:
    from .operators.conjugate import gaussian_wishart2

    li = table(spark, d, "lineitem")
    got = gaussian_wishart2(li, ["l_returnflag"], F.col("l_quantity").cast("double"), F.col("l_extendedprice") / 1000)
    return got.select("l_returnflag", *[F.round(c, 8 if "precision" in c else 6).alias(c) for c in got.columns[1:]])


@query(f"""
SELECT event_id, round({sql_cdf("x")}, 6) AS cdf, round({sql_pdf("x")}, 6) AS pdf, round({sql_digamma("(abs(x)+0.1)")}, 6) AS digamma FROM (SELECT event_id, (value - 50.0)/25.0 AS x FROM events)
""")
def normal_distribution(spark: SparkSession, d: str) -> DataFrame:
    x = (F.col("value") - 50.0) / 25.0
    return rounded(table(spark, d, "events").select("event_id", scalar.normal_cdf(x).alias("cdf"), scalar.normal_pdf(x).alias("pdf"), scalar.digamma(F.abs(x) + 0.1).alias("digamma")))


@query(f"""
WITH g AS (SELECT event_id, (value-50.0)/41.7 AS m, -(value-50.0)/83.4 AS a, (5-(value-50.0)/41.7)/2 AS b FROM events),
c AS (SELECT *, {sql_cdf("b")} - {sql_cdf("a")} AS p, {sql_pdf("a")} AS pa, {sql_pdf("b")} AS pb FROM g)
SELECT event_id, round(p, 6) AS probability, round(m + 2*(pa-pb)/p, 4) AS mean, round(4*(1 + (a*pa-b*pb)/p - ((pa-pb)/p)**2), 4) AS variance FROM c
""")
def truncated_gaussian(spark: SparkSession, d: str) -> DataFrame:
    got = factors.truncated_moments((F.col("value") - 50.0) / 41.7, F.lit(4.0), 0.0, 5.0)
    e = table(spark, d, "events").select("event_id", got.alias("t"))
    return e.select("event_id", F.round("t.probability", 6).alias("probability"), F.round("t.mean", 4).alias("mean"), F.round("t.variance", 4).alias("variance"))


@query(f"""
WITH g AS (SELECT l_orderkey, l_linenumber, l_quantity/4.03::DOUBLE AS a, l_extendedprice/4003.7 AS b FROM lineitem), z AS (SELECT *, (a-b)/5 AS z FROM g),
c AS (SELECT *, {sql_cdf("z")} AS p, {sql_pdf("z")} AS f FROM z), m AS (SELECT *, a*p + b*(1-p) + 5*f AS mean FROM c)
SELECT l_orderkey, l_linenumber, round(p, 6) AS greater, round(mean, 6) AS mean, round((a*a+9)*p + (b*b+16)*(1-p) + (a+b)*5*f - mean*mean, 5) AS variance FROM m
""")
def greater_and_maximum(spark: SparkSession, d: str) -> DataFrame:
    args = (F.col("l_quantity") / 4.03, F.lit(9.0), F.col("l_extendedprice") / 4003.7, F.lit(16.0))
    both = table(spark, d, "lineitem").select(*_KEYS, factors.greater_probability(*args).alias("greater"), factors.maximum_moments(*args).alias("t"))
    return both.select(*_KEYS, F.round("greater", 6).alias("greater"), F.round("t.mean", 6).alias("mean"), F.round("t.variance", 5).alias("variance"))


_STEP = sql_cdf("x")


@query(f"""
WITH RECURSIVE b AS (
  SELECT DISTINCT p_size, (p_size-0.5)/50.0::DOUBLE AS p, -5.0::DOUBLE AS lo, 5.0::DOUBLE AS hi, 0 AS k FROM part
  UNION ALL SELECT p_size, p, CASE WHEN c < p THEN x ELSE lo END, CASE WHEN c < p THEN hi ELSE x END, k + 1 FROM (SELECT *, {_STEP} AS c FROM (SELECT *, (lo+hi)/2 AS x FROM b)) WHERE k < 50)
SELECT p_partkey, round((lo+hi)/2 + 0.0, 6) + 0.0 AS quantile, round({sql_trigamma("(p_size/10.0::DOUBLE)")}, 6) AS trigamma FROM part JOIN (SELECT * FROM b WHERE k = 50) USING (p_size)
""")
def normal_quantiles(spark: SparkSession, d: str) -> DataFrame:
    p = (F.col("p_size") - 0.5) / 50.0
    return rounded(table(spark, d, "part").select("p_partkey", (F.round(scalar.normal_cdf_inverse(p), 6) + 0.0).alias("quantile"), scalar.trigamma(F.col("p_size") / 10.0).alias("trigamma")))


@query("""
WITH RECURSIVE o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n,
  CASE WHEN value > 50 THEN 0.2 ELSE 0.8 END::DOUBLE AS l0, CASE WHEN value > 50 THEN 0.7 ELSE 0.3 END::DOUBLE AS l1 FROM events),
f AS (
  SELECT user_id, k, n, 0.6*l0/(0.6*l0+0.4*l1) AS p0, 0.4*l1/(0.6*l0+0.4*l1) AS p1, ln(0.6*l0+0.4*l1) AS e FROM o WHERE k = 1
  UNION ALL
  SELECT user_id, k, n, a/(a+b), b/(a+b), e + ln(a+b) FROM (
    SELECT o.user_id, o.k, o.n, e, (0.9*p0+0.2*p1)*l0 AS a, (0.1*p0+0.8*p1)*l1 AS b FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1))
SELECT user_id, n, round(p1, 6) AS p1, round(e, 4) AS log_evidence FROM f WHERE k = n
""")
def hidden_markov_filter(spark: SparkSession, d: str) -> DataFrame:
    from .workload import _chain

    return _chain(spark, d).select("user_id", "n", F.round(F.col("p")[1], 6).alias("p1"), F.round("log_evidence", 4).alias("log_evidence"))


@query("""
WITH c AS (SELECT event_id, user_id, value/10.0::DOUBLE AS x FROM events)
SELECT event_id, round(sum(x) OVER w - x, 4) AS others, round(ln(sum(exp(x)) OVER w), 6) AS log_total, round(exp(x)/sum(exp(x)) OVER w, 8) AS share FROM c WINDOW w AS (PARTITION BY user_id)
""")
def log_sum_by_user(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", (F.col("value") / 10.0).alias("x"))
    w = Window.partitionBy("user_id")
    total = scalar.log_sum_exp_over(F.col("x"), w)
    return e.select("event_id", F.round(F.sum("x").over(w) - F.col("x"), 4).alias("others"), F.round(total, 6).alias("log_total"), F.round(F.exp(F.col("x") - total), 8).alias("share"))
