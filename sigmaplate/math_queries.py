"""Registered queries of special functions, kernels, intervals, vectors, matrices, samplers and string sets, with SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .factor_queries import sql_cdf, sql_pdf
from .functions import scalar, special
from .operators import automata, numerics, samplers, strings
from .workload import query, rounded, table


def sql_gamma_lower(a: str, x: str) -> str:
    return f"list_sum(list_transform(range(0, 160), lambda n: exp(({a}+n)*ln({x}) - {x} - lgamma({a}+n+1))))"


@query(f"""
WITH g AS (SELECT p_partkey, 0.7 + (p_partkey % 9)::DOUBLE AS a, p_size/5.3::DOUBLE AS x FROM part), l AS (SELECT *, {sql_gamma_lower("a", "x")} AS p, {sql_gamma_lower("a", "(x/2)")} AS q FROM g)
SELECT p_partkey, round(p, 6) AS lower, round(1-p, 6) AS upper, round(p - q, 6) AS between, round(exp(a*ln(x) - x - lgamma(a)), 6) AS scale, round(exp(lgamma(a+x) - lgamma(a) - lgamma(x)), 3) AS beta_inverse,
       round(exp(-lgamma(1+a)) - 1, 6) AS reciprocal, round((lgamma(a+x) - lgamma(a))/x, 6) AS rising,
       round(list_sum(list_transform(range(0, 60), lambda k: exp((2*k+a)*ln(x/2) - lgamma(k+1.0) - lgamma(k+a+1)))), 4) AS bessel FROM l
""")
def gamma_functions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", ((F.col("p_partkey") % 9) + 0.7).alias("a"), (F.col("p_size") / 5.3).alias("x"))
    a, x = F.col("a"), F.col("x")
    return p.select(
        "p_partkey", F.round(special.gamma_lower(a, x), 6).alias("lower"), F.round(special.gamma_upper(a, x), 6).alias("upper"),
        F.round(special.gamma_prob_between(a, F.lit(1.0), x / 2.0, x), 6).alias("between"), F.round(special.gamma_upper_scale(a, x), 6).alias("scale"),
        F.round(F.lit(1.0) / special.beta(a, x), 3).alias("beta_inverse"), F.round(special.reciprocal_factorial_minus1(a), 6).alias("reciprocal"),
        F.round(special.rising_factorial_ln_over_n(a, x), 6).alias("rising"), F.round(special.bessel_i(a, x), 4).alias("bessel"),
    )


@query(f"""
WITH e AS (SELECT event_id, (value - 50.0)/90.7 AS x, (event_id % 13)/4.1::DOUBLE - 1.5 AS y FROM events), c AS (SELECT *, {sql_cdf("x")} AS cx, {sql_cdf("y")} AS cy, {sql_pdf("x")} AS px FROM e)
SELECT event_id, round(ln(cx), 6) AS log_cdf, round(ln(cx) - ln(1-cx), 5) AS logit, round(cx/px, 5) AS ratio, round(ln(cx/px), 6) AS log_ratio, round(cx - cy, 6) AS diff,
       round((x*(x*cx/px+1) + cx/px)/2, 4) AS second_moment, round(ln(cx), 6) AS extended FROM c
""")
def normal_functions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", ((F.col("value") - 50.0) / 90.7).alias("x"), ((F.col("event_id") % 13) / 4.1 - 1.5).alias("y"))
    x, y = F.col("x"), F.col("y")
    return e.select(
        "event_id", scalar.signed_round(special.normal_cdf_ln(x), 6).alias("log_cdf"), scalar.signed_round(special.normal_cdf_logit(x), 5).alias("logit"), F.round(special.nearest_normal_cdf_ratio(x), 5).alias("ratio"),
        scalar.signed_round(special.normal_cdf_ratio_ln(x), 6).alias("log_ratio"), scalar.signed_round(special.normal_cdf_diff(x, y), 6).alias("diff"),
        F.round(special.normal_cdf_moment_ratio(2, x), 4).alias("second_moment"), scalar.signed_round(numerics.extended_log(special.normal_cdf_extended(x)), 6).alias("extended"),
    )


@query("""
WITH g AS (SELECT p_partkey, p_size/12.7::DOUBLE - 2 AS x, (p_partkey % 7)/2.9::DOUBLE - 1 AS y, (p_partkey % 5)/5.0::DOUBLE - 0.4 AS r FROM part),
s AS (SELECT p_partkey, x, y, r, unnest(range(0, 201)) AS k FROM g), t AS (SELECT *, -8 + k*(x+8)/200 AS t, CASE WHEN k IN (0, 200) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS w FROM s),
u AS (SELECT *, (y - r*t)/sqrt(1-r*r) AS z FROM t)
SELECT p_partkey, round(sum(w*(x+8)/600*{pdf}*{cdf}), 4) AS joint FROM u GROUP BY 1
""".replace("{pdf}", sql_pdf("t")).replace("{cdf}", sql_cdf("z")))
def bivariate_normal(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    x, y, r = F.col("p_size") / 12.7 - 2.0, (F.col("p_partkey") % 7) / 2.9 - 1.0, (F.col("p_partkey") % 5) / 5.0 - 0.4
    return p.select("p_partkey", F.round(special.normal_cdf2(x, y, r), 4).alias("joint"))


@query("""
WITH e AS (SELECT event_id, value/30.7 AS x, (event_id % 17)/5.3::DOUBLE + 0.1 AS y, [value/30.7, 1.0, -2.0, (event_id % 17)/5.3::DOUBLE] AS v FROM events)
SELECT event_id, round(ln((x+0.3)/y), 6) AS log_ratio, round(exp(x) - exp(y), 4) AS difference, round(((exp(y)-1)/y - 1)/y - 0.5, 6) AS remainder, round(-y - ln(1-exp(-y)), 6) AS logit, round(ln(list_sum([exp(a) for a in v])), 6) AS total,
       round(exp(v[3])/list_sum([exp(a) for a in v]), 8) AS share, round(ln((exp(x)+exp(y))/(exp(x)+exp(1.0))), 6) AS gap, list_position(v, list_max(v)) - 1 AS best, round(list_sort(v)[2]/2 + list_sort(v)[3]/2, 6) AS median,
       round(abs(x-y)/(least(abs(x), abs(y)) + 0.1), 6) AS apart, round((x*2+y*3)/5, 6) AS weighted, round(1 - sqrt(1 - y/10), 8) AS root, round(ln(list_sum([exp(a) for a in v]) + 6*exp(0.5)), 6) AS sparse FROM e
""")
def exponential_functions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", (F.col("value") / 30.7).alias("x"), ((F.col("event_id") % 17) / 5.3 + 0.1).alias("y"))
    x, y = F.col("x"), F.col("y")
    e = e.withColumn("v", F.array(x, F.lit(1.0), F.lit(-2.0), (F.col("event_id") % 17) / 5.3))
    v = F.col("v")
    columns = {
        "log_ratio": special.log_ratio(x + 0.3, y), "remainder": special.expm1_ratio_minus1_ratio_minus_half(y), "logit": special.logit_from_log(-y), "total": special.log_sum_exp(v),
        "gap": special.diff_log_sum_exp(x, y, F.lit(1.0)), "median": special.median(v), "apart": special.abs_diff(x, y, 0.1), "weighted": special.weighted_average(F.lit(2.0), x, F.lit(3.0), y),
        "sparse": special.log_sum_exp_sparse(v, F.lit(0.5), F.lit(10)),
    }
    return e.select(
        "event_id", *[F.round(c, 6).alias(n) for n, c in columns.items()], F.round(special.difference_of_exp(x, y), 4).alias("difference"), F.round(special.softmax(v)[2], 8).alias("share"),
        special.index_of_maximum(v).cast("long").alias("best"), F.round(special.one_minus_sqrt_one_minus(y / 10.0), 8).alias("root"),
    )


@query("""
SELECT p_partkey, round(1 - cos(p_size/10.0::DOUBLE), 6) AS sine, round((exp(p_size/25.0::DOUBLE) - 1), 6) AS growth, round(1/(1 + p_size/10.0::DOUBLE), 6) AS decay, round(exp(p_size/100.0::DOUBLE), 6) AS moment, round((1+sqrt(5.0))/2, 6) AS golden FROM part
""")
def quadrature(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size").cast("double")
    golden = numerics.continued_fraction(lambda k: F.lit(1.0), lambda k: F.lit(1.0), 60)
    return rounded(table(spark, d, "part").select(
        "p_partkey", special.over_interval(F.sin, F.lit(0.0), s / 10.0).alias("sine"), special.over_interval(F.exp, F.lit(0.0), s / 25.0).alias("growth"),
        numerics.laguerre(lambda t: F.exp(-t * s / 10.0), 128).alias("decay"), special.gaussian_mean_of(F.exp, F.lit(0.0), s / 50.0).alias("moment"), golden.alias("golden"),
    ))


@query("""
WITH p AS (SELECT a.vec_id AS i, b.vec_id AS j, a.embedding[1]::DOUBLE AS x1, a.embedding[2]::DOUBLE AS x2, b.embedding[1]::DOUBLE AS y1, b.embedding[2]::DOUBLE AS y2 FROM embeddings a JOIN embeddings b ON b.vec_id IN (a.vec_id, a.vec_id + 1)),
k AS (SELECT *, 0.8 + 0.5*x1*y1 + 2.0*x2*y2 AS l, 0.8 + 0.5*x1*x1 + 2.0*x2*x2 AS lx, 0.8 + 0.5*y1*y1 + 2.0*y2*y2 AS ly FROM p)
SELECT i, j, round(exp(-((x1-y1)**2 + (x2-y2)**2)/(2*0.49)), 6) AS smooth, round(4*exp(-((x1-y1)**2/0.25 + (x2-y2)**2/2.25)/2), 6) AS ard, round(l, 6) AS linear, round(2/pi()*asin(2*l/sqrt((1+2*lx)*(1+2*ly))), 6) AS neural,
       round(l + CASE WHEN i = j THEN 0.09 ELSE 0 END, 6) AS noisy FROM k
""")
def kernels(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 2), lambda v: v.cast("double")).alias("x"))
    a, b = e.select(F.col("vec_id").alias("i"), "x", F.explode(F.array(F.col("vec_id"), F.col("vec_id") + 1)).alias("j")), e.select(F.col("vec_id").alias("j"), F.col("x").alias("y"))
    x, y, ln = F.col("x"), F.col("y"), np.log
    linear = numerics.kernel("linear", [float(ln(0.5)), float(ln(2.0))], float(ln(0.8)))
    noisy = numerics.kernel("sum", linear, numerics.kernel("white_noise", float(ln(0.3))))
    return rounded(a.join(b, "j").select(
        "i", "j", numerics.kernel("squared_exponential", float(ln(0.7)))(x, y).alias("smooth"), numerics.kernel("ard", [float(ln(0.5)), float(ln(1.5))], float(ln(2.0)))(x, y).alias("ard"),
        linear(x, y).alias("linear"), numerics.kernel("neural", [float(ln(0.5)), float(ln(2.0))], float(ln(0.8)))(x, y).alias("neural"), noisy(x, y).alias("noisy"),
    ))


@query("""
WITH i AS (SELECT l_orderkey, l_linenumber, l_discount*10 - 0.53::DOUBLE AS a, l_discount*10 + l_tax*10 + 0.11::DOUBLE AS b, -l_quantity/10.3::DOUBLE AS c, l_tax*7.1::DOUBLE AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, round(a + c, 6) AS sum_lo, round(b - c, 6) AS difference_hi, round(least(a*c, a*d, b*c, b*d), 6) AS product_lo, round(greatest(a*c, a*d, b*c, b*d), 6) AS product_hi,
       round(CASE WHEN a <= 0 AND b >= 0 THEN 0 ELSE least(a*a, b*b) END, 6) AS square_lo, round(exp(b), 6) AS exp_hi, round(ln(b-a) + ln(d-c), 6) AS log_volume, (a <= 0.0 AND b >= 0.0 AND c <= -1.0 AND d >= -1.0) AS inside FROM i
""")
def intervals(spark: SparkSession, d: str) -> DataFrame:
    disc, tax, q = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")
    x, y = numerics.interval(disc * 10 - 0.53, disc * 10 + tax * 10 + 0.11), numerics.interval(-q / 10.3, tax * 7.1)
    i = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"))
    x, y = F.col("x"), F.col("y")
    p, region = numerics.interval_product(x, y), F.array(x, y)
    return rounded(i.select(
        "l_orderkey", "l_linenumber", numerics.interval_sum(x, y)["lo"].alias("sum_lo"), numerics.interval_difference(x, y)["hi"].alias("difference_hi"), p["lo"].alias("product_lo"), p["hi"].alias("product_hi"),
        numerics.interval_square(x)["lo"].alias("square_lo"), numerics.interval_map(x, F.exp)["hi"].alias("exp_hi"), numerics.region_log_volume(region).alias("log_volume"),
        numerics.region_contains(region, F.array(F.lit(0.0), F.lit(-1.0))).alias("inside"),
    ))


@query("""
WITH a AS (SELECT l_suppkey AS row, l_linenumber AS i, sum(l_quantity)/10.0 AS v FROM lineitem GROUP BY 1, 2), b AS (SELECT l_suppkey AS row, l_linenumber AS i, sum(l_tax) AS v FROM lineitem WHERE l_discount > 0.03 GROUP BY 1, 2),
d AS (SELECT coalesce(a.row, b.row) AS row, sum(coalesce(a.v, 0.5)*coalesce(b.v, 0.25)) AS s, count(*) AS n FROM a FULL JOIN b ON a.row = b.row AND a.i = b.i GROUP BY 1), t AS (SELECT row, sum(v) AS s, count(*) AS n, max(v) AS m FROM a GROUP BY 1)
SELECT d.row, round(d.s + (10-d.n)*0.125, 5) AS dot, round(t.s + (10-t.n)*0.5, 5) AS sum, round(greatest(m, 0.5), 5) AS max FROM d JOIN t ON d.row = t.row
""")
def sparse_vectors(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "row").withColumnRenamed("l_linenumber", "i")
    a = li.groupBy("row", "i").agg((F.sum("l_quantity") / 10.0).alias("v"))
    b = li.where("l_discount > 0.03").groupBy("row", "i").agg(F.sum("l_tax").alias("v"))
    return rounded(numerics.sparse_dot(a, b, "row", 0.5, 0.25, 10).join(numerics.sparse_sums(a, "row", 0.5, 10), "row"), 5)


@query("""
WITH p AS (SELECT user_id, min(event_id) AS lo, max(event_id) AS hi, round(avg(value), 3) AS v FROM events GROUP BY user_id, event_id // 500 HAVING min(event_id) % 3 <> 0)
SELECT e.event_id, e.user_id, coalesce(v, -1.0) AS v FROM (SELECT event_id, user_id FROM events) e LEFT JOIN p ON p.user_id = e.user_id AND e.event_id BETWEEN lo AND hi
""")
def piecewise_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    pieces = e.groupBy("user_id", F.floor(F.col("event_id") / 500).alias("b")).agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"), F.round(F.avg("value"), 3).alias("v")).where("lo % 3 <> 0")
    return numerics.piecewise_at(pieces, e.select("event_id", "user_id"), "user_id", "event_id", -1.0)


@query("""
WITH s AS (SELECT l_returnflag AS k, 1 + avg(l_quantity*l_quantity)/100 AS a, avg(l_quantity*l_discount)/10 AS b, 1 + avg(l_discount*l_discount) AS c FROM lineitem GROUP BY 1)
SELECT k, round(ln(a*c - b*b), 6) AS log_det, round((a+c)/(a*c-b*b), 6) AS trace_inverse, round((a+c)/2 + sqrt(((a-c)/2)**2 + b*b), 6) AS largest, round((c - 2*b)/(a*c-b*b), 6) AS first, round((2*a - b)/(a*c-b*b), 6) AS second FROM s
""")
def matrix_figures(spark: SparkSession, d: str) -> DataFrame:
    q, c = F.col("l_quantity").cast("double"), F.col("l_discount")
    s = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg((F.avg(q * q) / 100 + 1.0).alias("a"), (F.avg(q * c) / 10).alias("b"), (F.avg(c * c) + 1.0).alias("c"))
    m = s.select("k", F.array("a", "b", "b", "c").alias("m"), F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    got = numerics.matrix_figures(m, "k", "m", "v")
    return rounded(got.select("k", "log_det", "trace_inverse", "largest", F.col("solved")[0].alias("first"), F.col("solved")[1].alias("second")))


def _sql_uniform(key: str, salt: int) -> str:
    h = f"(({key} * 2654435761 + {salt * 40503 + 1}) % 4294967296)"
    for k in (15, 13):
        h = f"((xor({h}, {h} >> {k}) * 1597334677) % 4294967296)"
    return f"(({h} + 0.5) / 4294967296.0::DOUBLE)"


@query(f"""
SELECT o_orderkey, round({_sql_uniform("o_orderkey", 0)}, 9) AS uniform, round(2.0 + sqrt(3.0)*sqrt(-2*ln({_sql_uniform("o_orderkey", 1)}))*cos(2*pi()*{_sql_uniform("o_orderkey", 2)}), 6) AS normal,
       round(-ln({_sql_uniform("o_orderkey", 5)})/4, 6) AS exponential, floor({_sql_uniform("o_orderkey", 7)}*6)::BIGINT AS die FROM orders
""")
def hashed_samples(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey", F.round(samplers.uniform(k), 9).alias("uniform"), F.round(samplers.normal(k, F.lit(2.0), F.lit(3.0)), 6).alias("normal"),
        F.round(samplers.exponential(k, F.lit(4.0), 5), 6).alias("exponential"), samplers.whole_below(k, 6, 7).alias("die"),
    )


@query("""
SELECT p_partkey, regexp_full_match(p_name, '[A-Za-z]+') AS letters, regexp_full_match(p_brand, '[A-Z][a-z]+') AS capitalized, regexp_full_match(p_size::VARCHAR, '[0-9]+') AND length(p_size::VARCHAR) >= 2 AS long_digits,
       lower(p_type) = lower(upper(p_type)) AS same, strpos(p_name, ' ') = 0 OR true AS any FROM part
""")
def string_sets(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    return table(spark, d, "part").select(
        "p_partkey", strings.matches(F.col("p_name"), "letters").alias("letters"), strings.matches(F.col("p_brand"), "capitalized").alias("capitalized"),
        strings.matches(size, "digits", 2).alias("long_digits"), (F.lower("p_type") == F.lower(F.upper("p_type"))).alias("same"), strings.matches(F.col("p_name"), "any").alias("any"),
    )


@query("""
WITH c AS (SELECT source, unnest(string_split(lang, '')) AS character FROM documents), n AS (SELECT source, character, count(*) AS n FROM c WHERE character <> '' GROUP BY 1, 2)
SELECT source, character, n, round(n/sum(n) OVER (PARTITION BY source), 6) AS p FROM n
""")
def character_distributions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(strings.character_distribution(table(spark, d, "documents"), ["source"], "lang"))


@query("SELECT event_id, round(1/(1+exp(-value/40.3)), 6) AS logistic, round(value, 9) AS same FROM events")
def neighbouring_doubles(spark: SparkSession, d: str) -> DataFrame:
    """A double's neighbours lie half-way around it: their average is the number itself."""
    e = table(spark, d, "events")
    around = special.average(special.next_double(F.col("value")), special.previous_double(F.col("value")))
    return e.select("event_id", F.round(scalar.logistic(F.col("value") / 40.3), 6).alias("logistic"), F.round(around, 9).alias("same"))


@query("""
WITH p AS (SELECT DISTINCT p_brand FROM part)
SELECT p_brand, round(CASE WHEN regexp_full_match(p_brand, 'Brand#[0-9]+') THEN (length(p_brand) - 6)*ln(0.1) WHEN regexp_full_match(p_brand, '[A-Za-z]+') THEN 0 END, 6) AS log_value,
       replace(p_brand, '#', ' no. ') AS written FROM p
""")
def automaton_values(spark: SparkSession, d: str) -> DataFrame:
    a = automata
    brand = a.Automaton.constant("Brand#") + a.Automaton.element(a.DIGITS, float(np.log(0.1))).repeat(1)
    letters = a.Automaton.element(a.LETTERS).repeat(1)
    spell = (a.Transducer.copying(a.Automaton.element(a.Chars.of("#").complement())) | a.Transducer.replace("#", " no. ")).repeat()
    p = table(spark, d, "part").select("p_brand").distinct()
    v = automata.values(F.col("p_brand"), brand | letters)
    return p.select("p_brand", F.round(F.when(v > float("-inf"), v), 6).alias("log_value"), automata.written(F.col("p_brand"), spell)[0].alias("written"))


@query("""
WITH RECURSIVE w AS (SELECT 0 AS n, '' AS value, 0.0::DOUBLE AS l UNION ALL SELECT n + 1, value || c, l + p FROM w, (VALUES ('a', ln(0.5)), ('b', ln(0.3)), ('c', ln(0.2))) x(c, p) WHERE n < 4)
SELECT value, round(l, 6) AS log_value FROM w WHERE n >= 2 AND strpos(value, 'b') > 0
""")
def automaton_support(spark: SparkSession, d: str) -> DataFrame:
    a = automata
    letter = a.Automaton.element(a.Chars.of("a"), float(np.log(0.5))) | a.Automaton.element(a.Chars.of("b"), float(np.log(0.3))) | a.Automaton.element(a.Chars.of("c"), float(np.log(0.2)))
    other = a.Automaton.element(a.Chars.of("b").complement()).repeat()
    with_b = other + a.Automaton.constant("b") + a.Automaton.element(a.ANY).repeat()
    rows = [(s, float(w)) for s, w in (letter.repeat(2, 4) * with_b).support()]
    return rounded(spark.createDataFrame(rows, "value string, log_value double"))
