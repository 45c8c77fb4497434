"""Registered queries of whole models, estimators, evaluators and learners, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .factor_queries import sql_cdf, sql_digamma
from .functions import scalar
from .learners import recommender as bilinear
from .operators import estimators, metrics, models, relational, strings
from .session import materialized
from .workload import _RATINGS, _VOTES, _ratings, _votes, query, rounded, table

# Discrete networks


@query("""
WITH s AS (SELECT a, b, c, CASE WHEN a AND b THEN c ELSE NOT c END AS consistent, 0.25::DOUBLE AS w FROM (VALUES (true), (false)) x(a), (VALUES (true), (false)) y(b), (VALUES (true), (false)) z(c))
SELECT a::INT AS first, round(sum(w)/(SELECT sum(w) FROM s WHERE consistent AND NOT c), 6) AS probability FROM s WHERE consistent AND NOT c GROUP BY 1
""")
def two_coins(spark: SparkSession, d: str) -> DataFrame:
    joint = models.states(spark, ["first", "second"])
    not_both = ~((F.col("first") == 1) & (F.col("second") == 1))
    return rounded(models.marginal(joint, F.lit(0.25), "first", not_both))


@query("""
WITH r(rain, pr) AS (VALUES (1, 0.2::DOUBLE), (0, 0.8::DOUBLE)), s(rain, sprinkler, ps) AS (VALUES (1, 1, 0.01::DOUBLE), (1, 0, 0.99::DOUBLE), (0, 1, 0.4::DOUBLE), (0, 0, 0.6::DOUBLE)),
g(rain, sprinkler, pg) AS (VALUES (1, 1, 0.99::DOUBLE), (1, 0, 0.8::DOUBLE), (0, 1, 0.9::DOUBLE), (0, 0, 0.0::DOUBLE)), j AS (SELECT rain, pr*ps*pg AS w FROM r JOIN s USING (rain) JOIN g USING (rain, sprinkler))
SELECT rain, round(sum(w)/(SELECT sum(w) FROM j), 6) AS probability FROM j GROUP BY rain
""")
def wet_grass(spark: SparkSession, d: str) -> DataFrame:
    joint = models.states(spark, ["rain", "sprinkler"])
    cpt = lambda rows, names: spark.createDataFrame(rows, names)
    joint = models.table_lookup(joint, cpt([(1, 0.2), (0, 0.8)], "rain int, p double"), ["rain"], "pr")
    joint = models.table_lookup(joint, cpt([(1, 1, 0.01), (1, 0, 0.99), (0, 1, 0.4), (0, 0, 0.6)], "rain int, sprinkler int, p double"), ["rain", "sprinkler"], "ps")
    joint = models.table_lookup(joint, cpt([(1, 1, 0.99), (1, 0, 0.8), (0, 1, 0.9), (0, 0, 0.0)], "rain int, sprinkler int, p double"), ["rain", "sprinkler"], "pg")
    return rounded(models.marginal(joint, F.col("pr") * F.col("ps") * F.col("pg"), "rain"))


@query("""
WITH g AS (SELECT lang = 'en' AS arm, sum(toxic)::DOUBLE AS y, count(*)::DOUBLE AS m FROM documents JOIN labels USING (doc_id) GROUP BY 1),
e AS (SELECT sum(lgamma(y+1) + lgamma(m-y+1) - lgamma(m+2)) AS each, lgamma(sum(y)+1) + lgamma(sum(m)-sum(y)+1) - lgamma(sum(m)+2) AS common FROM g)
SELECT round(common, 5) AS common, round(each, 5) AS each, round(1/(1+exp(common-each)), 6) AS effective FROM e
""")
def trial_evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", (F.col("lang") == "en").alias("arm")).join(table(spark, d, "labels"), "doc_id")
    arms = rows.groupBy("arm").agg(F.sum("toxic").alias("yes"), F.count("*").alias("n"))
    got = models.two_rate_evidence(arms, "yes", "n", "arm")
    return got.select(F.round("common", 5).alias("common"), F.round("each", 5).alias("each"), F.round("effective", 6).alias("effective"))


def _vmp(sweeps: int) -> str:
    sql = "SELECT o_orderpriority, n, x, s, 0.0::DOUBLE AS m, 100.0::DOUBLE AS v, 1 + n/2.0::DOUBLE AS shape, 1.0::DOUBLE AS rate FROM st"
    for _ in range(sweeps):
        sql = f"SELECT o_orderpriority, n, x, s, v*(n*shape/rate*x) AS m, v, shape, rate FROM (SELECT *, 1/(0.01 + n*shape/rate) AS v FROM (SELECT o_orderpriority, n, x, s, m, shape, 1 + n*(s + (x-m)*(x-m) + v)/2 AS rate FROM ({sql})))"
    return sql


@query(f"""
WITH st AS (SELECT o_orderpriority, count(*)::DOUBLE AS n, avg(o_totalprice/100000.0) AS x, var_pop(o_totalprice/100000.0) AS s FROM orders GROUP BY 1)
SELECT o_orderpriority, round(m, 6) AS m, round(v, 9) AS v, round(shape/rate, 6) AS precision FROM ({_vmp(4)})
""")
def learning_a_gaussian(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("o_totalprice") / 100000.0
    stats = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").cast("double").alias("n"), F.avg(x).alias("x"), F.var_pop(x).alias("s"))
    got = models.gaussian_sweeps(stats, "n", "x", "s", 4, 0.0, 100.0, 1.0, 1.0)
    return got.select("o_orderpriority", F.round("m", 6).alias("m"), F.round("v", 9).alias("v"), F.round(F.col("shape") / F.col("rate"), 6).alias("precision"))


@query("""
WITH st AS (SELECT c_mktsegment, count(*)::DOUBLE AS n, avg(c_acctbal/1000) AS x, var_pop(c_acctbal/1000) AS s FROM customer GROUP BY 1)
SELECT c_mktsegment, round(-0.5*(n*ln(2*pi()*9.0) + n*s/9.0) - 0.5*(ln(25.0 + 9.0/n) - ln(9.0/n) + (x-4.0)**2/(25.0 + 9.0/n)), 5) AS log_evidence FROM st
""")
def gaussian_evidence(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("c_acctbal") / 1000
    stats = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.avg(x).alias("x"), F.var_pop(x).alias("s"))
    return rounded(models.gaussian_evidence(stats, "n", "x", "s", 4.0, 25.0, 9.0).select("c_mktsegment", "log_evidence"), 5)


@query(f"""
WITH p AS (SELECT event_type, (sum(value)/400.0 + 50.0/100.0)/(count(*)/400.0 + 1/100.0) AS m, 1/(count(*)/400.0 + 1/100.0) AS v FROM events GROUP BY 1)
SELECT a.event_type AS a, b.event_type AS b, round({sql_cdf("((b.m-a.m)/sqrt(a.v+b.v+800.0))")}, 6) AS faster FROM p a JOIN p b ON a.event_type < b.event_type
""")
def two_cyclists(spark: SparkSession, d: str) -> DataFrame:
    n, s = F.count("value"), F.sum("value")
    prec = n / 400.0 + 1 / 100.0
    p = table(spark, d, "events").groupBy("event_type").agg(((s / 400.0 + 50.0 / 100.0) / prec).alias("m"), (F.lit(1.0) / prec).alias("v"))
    a, b = p.alias("a"), p.alias("b")
    both = a.join(b, F.col("a.event_type") < F.col("b.event_type"))
    f = models.faster(F.col("a.m"), F.col("a.v") + 400.0, F.col("b.m"), F.col("b.v") + 400.0)
    return both.select(F.col("a.event_type").alias("a"), F.col("b.event_type").alias("b"), F.round(f, 6).alias("faster"))


# Words and topics

_STOP = ["the", "and", "of", "to", "in", "is"]
_WORDS = """
SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+')) AS word FROM documents) WHERE word NOT IN ('', 'the', 'and', 'of', 'to', 'in', 'is') GROUP BY 1, 2
"""


@query(f"""
WITH c AS ({_WORDS}), v AS (SELECT word, count(*) AS df FROM c GROUP BY word HAVING sum(n) >= 3),
w AS (SELECT doc_id, word, n*ln((SELECT count(*) FROM documents)/(1.0+df)) AS w FROM c JOIN v USING (word))
SELECT doc_id, word, round(w/nullif(sqrt(sum(w*w) OVER (PARTITION BY doc_id)), 0), 6) AS weight FROM w
""")
def tf_idf(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return rounded(models.tf_idf(models.words(docs, "doc_id", "text", _STOP), "doc_id", docs))


def _event_words(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("user"), F.concat_ws("-", "event_type", (F.col("value") / 10).cast("int").cast("string")).alias("word"))
    return e.groupBy("user", "word").agg(F.count("*").alias("n"))


@query()
def topic_model(spark: SparkSession, d: str) -> DataFrame:
    counts = materialized(_event_words(spark, d))
    belief = None
    for _ in range(3):
        belief = materialized(models.topic_sweep(counts, "user", 3, belief))
    return belief.select("user", "word", "n", F.transform("p", lambda x: F.round(x, 5)).alias("p"))


# Crowds

_BELIEF = f"WITH v AS ({_VOTES}), b AS (SELECT task, x.label, avg((v.label = x.label)::INT) AS p FROM v, (VALUES (0), (1)) x(label) GROUP BY 1, 2),"


def _belief(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    votes = _votes(spark, d).select("task", F.col("worker"), F.col("label").alias("vote"))
    share = votes.groupBy("task").agg(F.avg(F.col("vote").cast("double")).alias("one"))
    rows = F.array(F.struct(F.lit(0).alias("label"), (F.lit(1.0) - F.col("one")).alias("p")), F.struct(F.lit(1).alias("label"), F.col("one").alias("p")))
    return votes, share.select("task", F.explode(rows).alias("r")).select("task", "r.label", "r.p")


@query(_BELIEF + """
c AS (SELECT worker, b.label, v.label AS vote, sum(p) AS m FROM v JOIN b USING (task) GROUP BY 1, 2, 3), m AS (SELECT *, ln((m+1.0)/(sum(m) OVER (PARTITION BY worker, label) + 2.0)) AS l FROM c),
pr AS (SELECT label, ln(sum(p)/(SELECT sum(p) FROM b)) AS prior FROM b GROUP BY 1), s AS (SELECT task, m.label, sum(l) + any_value(prior) AS s FROM v JOIN m ON m.worker = v.worker AND m.vote = v.label JOIN pr ON pr.label = m.label GROUP BY 1, 2)
SELECT task, label, round(exp(s)/sum(exp(s)) OVER (PARTITION BY task), 6) AS p FROM s
""")
def crowd_confusion(spark: SparkSession, d: str) -> DataFrame:
    votes, belief = _belief(spark, d)
    return rounded(models.confusion_sweep(votes, belief, [0, 1]))


@query(_BELIEF + "c AS (SELECT worker % 2 AS community, b.label, v.label AS vote, sum(p) AS m FROM v JOIN b USING (task) GROUP BY 1, 2, 3) SELECT community, label, vote, round((m+1.0)/(sum(m) OVER (PARTITION BY community, label) + 2.0), 6) AS p FROM c")
def community_confusion(spark: SparkSession, d: str) -> DataFrame:
    votes, belief = _belief(spark, d)
    community = votes.select("worker", (F.col("worker") % 2).alias("community")).distinct()
    return rounded(models.community_confusion(votes, belief, community, [0, 1]))


@query(_BELIEF + "e AS (SELECT task, sum(CASE WHEN p > 0 THEN -p*ln(p) ELSE 0 END) AS entropy FROM b GROUP BY 1) SELECT task, round(entropy, 6) AS entropy FROM e ORDER BY round(e.entropy, 9) DESC, task LIMIT 20")
def most_uncertain(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.most_uncertain(_belief(spark, d)[1], 20))


@query("""
WITH t AS (SELECT doc_id, quality = 1 AS q1, toxic = 1 AS q2, (quality + toxic) >= 1 AS q3 FROM labels), s(a, b) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1)),
w AS (SELECT doc_id, a, b, (CASE WHEN q1 = (a = 1) THEN CASE WHEN a = 1 THEN 0.9 ELSE 0.8 END ELSE CASE WHEN a = 1 THEN 0.1 ELSE 0.2 END END) * (CASE WHEN q2 = (b = 1) THEN CASE WHEN b = 1 THEN 0.9 ELSE 0.8 END ELSE CASE WHEN b = 1 THEN 0.1 ELSE 0.2 END END)
  * (CASE WHEN q3 = (a = 1 AND b = 1) THEN CASE WHEN a = 1 AND b = 1 THEN 0.9 ELSE 0.8 END ELSE CASE WHEN a = 1 AND b = 1 THEN 0.1 ELSE 0.2 END END)::DOUBLE AS w FROM t, s)
SELECT doc_id, round(sum(a*w)/sum(w), 6) AS reading, round(sum(b*w)/sum(w), 6) AS writing FROM w GROUP BY 1
""")
def student_skills(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("q1"), (F.col("toxic") == 1).alias("q2"), (F.col("quality") + F.col("toxic") >= 1).alias("q3"))
    return rounded(models.skill_posterior(t, "doc_id", {"q1": ["reading"], "q2": ["writing"], "q3": ["reading", "writing"]}, 0.2, 0.1))


@query("""
WITH e AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, value > 80 AS c FROM events), f AS (SELECT user_id, min(r) FILTER (c) AS f FROM e GROUP BY 1)
SELECT event_type, count(*) AS examined, count(*) FILTER (c) AS clicks, round((count(*) FILTER (c) + 1.0)/(count(*) + 2.0), 6) AS appeal FROM e JOIN f USING (user_id) WHERE f IS NULL OR r <= f GROUP BY 1
""")
def click_cascade(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, d, "events").select("user_id", "event_type", "value", rank.alias("r"))
    return rounded(models.cascade(e, "user_id", "r", F.col("value") > 80, "event_type"))


_MOTIF = [{"S": 0.6, "P": 0.2}, {"t": 0.3, "a": 0.3, "r": 0.2}, {"e": 0.5, "o": 0.2}]


def _motif_sql() -> str:
    terms = []
    for k, of in enumerate(_MOTIF):
        cases = " ".join(f"WHEN '{c}' THEN {w}" for c, w in of.items())
        terms.append(f"ln(CASE p_name[i+{k + 1}:i+{k + 1}] {cases} ELSE 0.001 END / 0.02)")
    return " + ".join(terms)


@query(f"""
WITH e AS (SELECT p_partkey, p_name, unnest(range(0, length(p_name) - 2)) AS i FROM part), s AS (SELECT p_partkey, i, ({_motif_sql()})::DOUBLE AS s FROM e)
SELECT p_partkey, i::INT AS position, round(exp(s)/sum(exp(s)) OVER (PARTITION BY p_partkey), 6) AS p FROM s
""")
def motif_positions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.motif_positions(table(spark, d, "part"), "p_partkey", "p_name", _MOTIF, 0.02))


@query("""
WITH s AS (SELECT l_suppkey AS judge, l_partkey AS item, l_quantity/10.0::DOUBLE AS x FROM lineitem), q AS (SELECT item, sum(x)/(count(*)+1.0) AS q FROM s GROUP BY 1),
o AS (SELECT judge, sum(x-q)/(count(*)+1.0) AS o FROM s JOIN q USING (item) GROUP BY 1) SELECT item, round(sum(x-o)/(count(*)+1.0), 6) AS quality FROM s JOIN o USING (judge) GROUP BY 1
""")
def calibrated_scores(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("judge"), F.col("l_partkey").alias("item"), (F.col("l_quantity") / 10.0).alias("x"))
    return rounded(models.calibrated_scores(r, "item", "judge", "x", sweeps=1))


@query()
def skill_round(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    a, b = e.alias("a"), e.alias("b")
    both = a.join(b, (F.col("b.event_id") == F.col("a.event_id") + 1) & (F.col("a.user_id") != F.col("b.user_id")))
    first = F.col("a.value") >= F.col("b.value")
    games = both.select(F.when(first, F.col("a.user_id")).otherwise(F.col("b.user_id")).alias("winner"), F.when(first, F.col("b.user_id")).otherwise(F.col("a.user_id")).alias("loser"))
    skills = e.select(F.col("user_id").alias("player")).distinct().select("player", F.lit(0.0).alias("mean"), F.lit(9.0).alias("variance"))
    return rounded(models.skill_round(games, skills, 1.0))


# Estimators


@query("""
WITH e AS (SELECT event_type, value AS x, exp(-value/70.3) AS w FROM events) SELECT event_type, round(sum(w*x)/sum(w), 6) AS mean, round(sum(w*x*x)/sum(w) - (sum(w*x)/sum(w))**2, 4) AS variance FROM e GROUP BY 1
""")
def log_weighted_moments(spark: SparkSession, d: str) -> DataFrame:
    m = estimators.log_weighted_moments(table(spark, d, "events"), ["event_type"], F.col("value"), -F.col("value") / 70.3)
    return m.select("event_type", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


@query("SELECT label, i::INT AS i, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance FROM (SELECT label, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1, 2")
def vector_moments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(estimators.vector_moments(table(spark, d, "embeddings"), ["label"], "embedding"))


@query("""
WITH c AS (SELECT user_id, event_type, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2), u AS (SELECT DISTINCT user_id FROM c), t AS (SELECT DISTINCT event_type FROM c),
s AS (SELECT u.user_id, t.event_type, (coalesce(n, 0)+0.5)/(sum(coalesce(n, 0)+0.5) OVER (PARTITION BY u.user_id)) AS p FROM u CROSS JOIN t LEFT JOIN c ON c.user_id = u.user_id AND c.event_type = t.event_type),
m AS (SELECT event_type, avg(p) AS m, avg(p*p) AS q FROM s GROUP BY 1)
SELECT event_type, round(m*(SELECT sum(m-q)/sum(q-m*m) FROM m), 5) AS pseudo_count FROM m
""")
def dirichlet_estimator(spark: SparkSession, d: str) -> DataFrame:
    from .operators import conjugate

    p = conjugate.dirichlet_discrete(table(spark, d, "events").select("user_id", "event_type"), ["user_id"], "event_type", 0.5)
    return rounded(estimators.dirichlet_by_moments(p, [], "event_type", F.col("mean")), 5)


@query("SELECT o_orderpriority, round(m*m/v, 6) AS shape, round(m/v, 8) AS rate, 2.0::DOUBLE AS power FROM (SELECT o_orderpriority, avg(sqrt(o_totalprice)) AS m, var_pop(sqrt(o_totalprice)) AS v FROM orders GROUP BY 1)")
def gamma_power_estimator(spark: SparkSession, d: str) -> DataFrame:
    g = estimators.gamma_power_by_moments(table(spark, d, "orders"), ["o_orderpriority"], F.col("o_totalprice"), 2.0)
    return g.select("o_orderpriority", F.round("shape", 6).alias("shape"), F.round("rate", 8).alias("rate"), "power")


@query("SELECT user_id, arg_max(value, event_id) AS point, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance, min(value) AS lower, max(value) AS upper FROM events GROUP BY 1")
def bounded_estimators(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    t = estimators.truncated_by_moments(e, ["user_id"], F.col("value"))
    both = estimators.point_mass(e, ["user_id"], F.col("event_id"), F.col("value")).join(t, "user_id")
    return both.select("user_id", "point", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), "lower", "upper")


@query("""
WITH o AS (SELECT l_suppkey, avg(l_quantity) AS a, avg(l_discount*100) AS b FROM lineitem GROUP BY 1), s AS (SELECT l_suppkey, avg((l_quantity-a)**2) AS xx, avg((l_quantity-a)*(l_discount*100-b)) AS xy, avg((l_discount*100-b)**2) AS yy FROM lineitem JOIN o USING (l_suppkey) GROUP BY 1)
SELECT round((avg(xx)**2 + avg(yy)**2)/(var_pop(xx) + var_pop(yy)), 4) AS shape, round(avg(xx), 5) AS xx, round(avg(xy), 5) AS xy, round(avg(yy), 5) AS yy FROM s
""")
def wishart_estimator(spark: SparkSession, d: str) -> DataFrame:
    q, c = F.col("l_quantity").cast("double"), F.col("l_discount") * 100
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.var_pop(q).alias("xx"), F.covar_pop(q, c).alias("xy"), F.var_pop(c).alias("yy"))
    got = estimators.wishart_by_moments(s, [], F.col("xx"), F.col("xy"), F.col("yy"))
    return got.select(F.round("shape", 4).alias("shape"), *[F.round(c, 5).alias(c) for c in ("xx", "xy", "yy")])


@query("SELECT user_id % 50 AS chain, ((event_id - 200) / 3)::BIGINT AS k, value FROM events WHERE event_id >= 200 AND (event_id - 200) % 3 = 0")
def sample_list(spark: SparkSession, d: str) -> DataFrame:
    return estimators.sample_list(table(spark, d, "events").withColumn("chain", F.col("user_id") % 50), ["chain"], "event_id", "value", 200, 3)


@query("""
WITH g AS (SELECT n_regionkey, n_nationkey, count(*)::DOUBLE AS w, avg(c_acctbal) AS m, var_pop(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT n_regionkey, count(*)::INT AS components, round(max(w)/sum(w), 6) AS heaviest, round(sum(w*m)/sum(w), 4) AS mean FROM g GROUP BY 1
""")
def mixture_components(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    g = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_nationkey")
    g = g.agg(F.count("*").cast("double").alias("w"), F.avg("c_acctbal").alias("m"), F.var_pop("c_acctbal").alias("v"))
    got = estimators.mixture_of_components(g, ["n_regionkey"], F.col("w"), F.col("m"), F.col("v"))
    heaviest = F.array_max(F.transform("parts", lambda p: p["weight"]))
    return got.select("n_regionkey", F.size("parts").alias("components"), F.round(heaviest, 6).alias("heaviest"), F.round("mean", 4).alias("mean"))


@query("""
WITH q AS (SELECT event_type, quantile_cont(value, 0.1) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.7) AS c FROM events GROUP BY 1)
SELECT event_id, round(CASE WHEN value < a THEN 0.1 WHEN value < b THEN 0.1 + 0.4*(value-a)/(b-a) WHEN value < c THEN 0.5 + 0.2*(value-b)/(c-b) ELSE 0.7 END, 6) AS below FROM events JOIN q USING (event_type)
""")
def irregular_quantiles(spark: SparkSession, d: str) -> DataFrame:
    e, ps = table(spark, d, "events"), [0.1, 0.5, 0.7]
    q = e.groupBy("event_type").agg(F.percentile("value", F.array(*map(F.lit, ps))).alias("q"))
    return rounded(e.join(q, "event_type").select("event_id", estimators.irregular_cdf(ps, F.col("q"), F.col("value")).alias("below")))


# Sets and order


@query("""
SELECT 'both' AS kind, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 40 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity < 5)
UNION ALL SELECT 'only', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 40 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 5)
UNION ALL SELECT 'pairs', (SELECT count(*) FROM region) * (SELECT count(*) FROM nation)
UNION ALL SELECT 'merged', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT l_partkey FROM lineitem WHERE l_quantity < 5)
""")
def set_algebra(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    high, low = li.where("l_quantity > 40").select("l_partkey"), li.where("l_quantity < 5").select("l_partkey")
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    pairs = relational.cartesian(table(spark, d, "region").select("r_regionkey"), table(spark, d, "nation").select("n_nationkey"))
    parts = [count(relational.intersection([high, low]), "both"), count(high.subtract(low), "only"), count(pairs, "pairs"), count(relational.merged([high, low], ["l_partkey"]), "merged")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("WITH k AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INT AS place FROM events) SELECT * FROM k WHERE place <= 3")
def largest_by_user(spark: SparkSession, d: str) -> DataFrame:
    return models.rolling_top(table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.col("event_id")], 3)


@query("SELECT user_id, dense_rank() OVER (ORDER BY user_id) - 1 AS index, strpos(event_type, 'c') AS place, length(event_type) AS size, event_type[2:4] AS middle FROM (SELECT DISTINCT user_id, event_type FROM events)")
def indexed_users(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type").distinct()
    index = relational.indexed(e, "user_id")
    t = F.col("event_type")
    return e.join(index, "user_id").select("user_id", "index", F.locate("c", t).cast("long").alias("place"), F.length(t).cast("long").alias("size"), F.substring(t, 2, 3).alias("middle"))


@query("""
WITH d AS (SELECT p_partkey, 'Brand ' || p_brand || ', size ' || p_size::VARCHAR || '.' AS line FROM part)
SELECT p_partkey, line, regexp_extract(line, '^Brand (.*), size (\\d+)\\.$', 1) AS brand, regexp_extract(line, '^Brand (.*), size (\\d+)\\.$', 2)::INT AS size FROM d
""")
def string_format(spark: SparkSession, d: str) -> DataFrame:
    line = strings.formatted("Brand {0}, size {1}.", [F.col("p_brand"), F.col("p_size").cast("string")])
    p = table(spark, d, "part").select("p_partkey", line.alias("line"))
    brand, size = strings.parsed("Brand {0}, size {1}.", F.col("line"), [".*", r"\d+"])
    return p.select("p_partkey", "line", brand.alias("brand"), size.cast("int").alias("size"))


@query("""
WITH l AS (SELECT lang, ln(count(*)/(SELECT count(*) FROM documents)) AS a FROM documents GROUP BY 1), s AS (SELECT source, ln(count(*)/(SELECT count(*) FROM documents)) AS b FROM documents GROUP BY 1)
SELECT lang || ' ' || source AS value, round(a + b, 6) AS logp FROM l CROSS JOIN s
""")
def hello_strings(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("all", F.lit(1))
    a, b = strings.support(docs, "all", "lang").drop("all"), strings.support(docs, "all", "source").drop("all")
    return rounded(strings.concatenated(a, "lang", b, "source", " "))


# Recommender and evaluators


@query()
def bilinear_predictions(spark: SparkSession, d: str) -> DataFrame:
    ratings = _ratings(spark, d)
    model = bilinear.train(ratings, bilinear.Settings(traits=2, sweeps=3))
    got = bilinear.expected_rating(ratings, model)
    return got.select("user", "item", "rating", F.round("expected", 4).alias("expected"))


_LISTED = f"SELECT usr, item, row_number() OVER (PARTITION BY usr ORDER BY (item*37 + usr*11) % 1009, item)::INT AS place FROM ({_RATINGS})"


def _listed(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user").orderBy((F.col("item") * 37 + F.col("user") * 11) % 1009, "item"))
    return _ratings(spark, d).select("user", "item", place.alias("place")).where("place <= 5")


@query(f"""
WITH r AS ({_RATINGS}), l AS (SELECT usr, item, place, rating AS g FROM ({_LISTED}) JOIN r USING (usr, item) WHERE place <= 5 AND usr IN (SELECT usr FROM r GROUP BY 1 HAVING count(*) >= 3)),
k AS (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY place, item) AS p FROM l), b AS (SELECT usr, rating, row_number() OVER (PARTITION BY usr ORDER BY rating DESC, item) AS p FROM r),
s AS (SELECT usr, sum(g/log2(p+1.0)) AS dcg, max(p) AS n FROM k GROUP BY 1), i AS (SELECT usr, sum(rating/log2(b.p+1.0)) AS ideal FROM b JOIN s USING (usr) WHERE b.p <= s.n GROUP BY 1)
SELECT usr AS "user", round(dcg/ideal, 6) AS ndcg FROM s JOIN i USING (usr)
""")
def recommendation_ndcg(spark: SparkSession, d: str) -> DataFrame:
    ratings = _ratings(spark, d)
    return rounded(metrics.recommendation_ndcg(metrics.rated_item_lists(_listed(spark, d), ratings, 3), ratings, 5))


@query(f"""
WITH r AS ({_RATINGS}) SELECT a.usr AS a, b.usr AS b, count(*) AS common, round(1/(1+avg(abs(a.rating-b.rating))), 6) AS similarity FROM r a JOIN r b ON a.item = b.item AND a.usr < b.usr GROUP BY 1, 2 HAVING count(*) >= 2
""")
def co_rated_users(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.co_rated(_ratings(spark, d), "user", "item", 2))


_GUESSED = f"SELECT usr, rating, ((usr*7 + item*3) % 5 + 1)::BIGINT AS predicted FROM ({_RATINGS})"


@query(f"""
WITH g AS ({_GUESSED}), c AS (SELECT usr, rating, predicted, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY usr) AS s FROM g GROUP BY 1, 2, 3)
SELECT rating AS truth, predicted, round(sum(s)/(SELECT count(DISTINCT usr) FROM g), 6) AS share FROM c GROUP BY 1, 2
""")
def confusion_by_user(spark: SparkSession, d: str) -> DataFrame:
    g = _ratings(spark, d).withColumn("predicted", (F.col("user") * 7 + F.col("item") * 3) % 5 + 1)
    return rounded(metrics.normalised_confusion(g, "rating", "predicted", "user"))


@query(f"SELECT round(avg((rating - predicted)**2)::DOUBLE, 6) AS loss FROM ({_GUESSED})")
def weighted_confusion(spark: SparkSession, d: str) -> DataFrame:
    g = _ratings(spark, d).withColumn("predicted", (F.col("user") * 7 + F.col("item") * 3) % 5 + 1)
    gap = F.col("truth") - F.col("predicted")
    return rounded(metrics.weighted_confusion(metrics.normalised_confusion(g, "rating", "predicted"), (gap * gap).cast("double")))


@query(f"""
WITH g AS (SELECT usr, rating, unnest(range(1, 6)) AS level, unnest([1.0, 1.0 + usr % 3, 2.0, 1.0 + item % 4, 1.0]) AS w, 6.0 + usr % 3 + item % 4 AS z FROM ({_RATINGS}))
SELECT rating, round(avg(e), 6) AS expected FROM (SELECT rating, 5*abs(rating - level)*w/z AS e FROM g) GROUP BY 1
""")
def expected_absolute_error(spark: SparkSession, d: str) -> DataFrame:
    u, i = F.col("user") % 3 + 1.0, F.col("item") % 4 + 1.0
    raw = F.array(F.lit(1.0), u, F.lit(2.0), i, F.lit(1.0))
    r = _ratings(spark, d).withColumn("p", F.transform(raw, lambda x: x / (u + i + 4.0)))
    return rounded(metrics.expected_metric(r, ["rating"], "p", 1, lambda t, level: F.abs(t - level)))


@query("""
WITH e AS (SELECT event_id, 1.0 + (event_id % 7) AS a, 2.0 + value/10 AS b FROM events)
SELECT event_id, round({0}, 6) AS digamma_gap FROM e
""".replace("{0}", f"{sql_digamma('(a+b)')} - {sql_digamma('a')}"))
def digamma_gaps(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("event_id") % 7 + 1.0, F.col("value") / 10 + 2.0
    return rounded(table(spark, d, "events").select("event_id", (scalar.digamma(a + b) - scalar.digamma(a)).alias("digamma_gap")))
