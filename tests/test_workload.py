"""Every registered query with SQL against DuckDB on the smallest tables; the others against plain Python."""

import math
from decimal import Decimal, localcontext

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmaplate import factor_queries, math_queries, model_queries, variable_queries, workload  # noqa: F401
from sigmaplate.functions import scalar, special
from sigmaplate.learners import classifier, mixture
from sigmaplate.operators import linear_algebra, messages, metrics, recommender
from sigmaplate.sources import formats
from sigmaplate.streaming import posterior

TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels conversations".split()


@pytest.fixture(scope="session")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def plain(v):
    return round(float(v), 4) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(workload.SQL))
def test_query(spark, small, con, name):
    df = workload.QUERIES[name](spark, small)
    cursor = con.execute(workload.SQL[name])
    order = [c[0] for c in cursor.description]
    assert sorted(order) == sorted(df.columns)
    got = sorted(([plain(r[c]) for c in order] for r in df.collect()), key=repr)
    want = sorted(([plain(v) for v in r] for r in cursor.fetchall()), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(a == b or isinstance(a, float) and a == pytest.approx(b, abs=2e-3, rel=1e-5) for a, b in zip(g, w)), (g, w)


def test_special_functions(spark):
    xs = [-6.0, -2.5, -1.0, -1e-9, 0.0, 0.3, 1.0, 2.4999, 2.5, 4.0, 9.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", scalar.erfc(F.col("x")).alias("e"), scalar.gamma_ln(F.abs("x") + 0.01).alias("g"), scalar.log1p_exp(F.col("x") * 200).alias("s")).collect():
        assert r.e == pytest.approx(math.erfc(r.x), rel=1e-9, abs=1e-15) and r.g == pytest.approx(math.lgamma(abs(r.x) + 0.01), rel=1e-10, abs=1e-12)
        assert r.s == pytest.approx(max(r.x * 200, 0) + math.log1p(math.exp(-abs(r.x * 200))))


def test_normal_functions_of_large_values(spark, tmp_path):
    """Figures of many digits against 60-digit decimals, and zeros of the sign that SQL gives them."""
    values = [455.0, 493.7, 520.16, 540.5, 560.21, 588.88, 600.0, 650.0, 700.0, 750.0, 780.0, 850.0, 3300.0]
    rows = [(k * 13, v) for k, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: r for r in workload.QUERIES["normal_functions"](spark, str(tmp_path)).collect()}
    df = spark.createDataFrame([((v - 50.0) / 90.7,) for v in values], "x double")
    nearest = df.select(special.nearest_normal_cdf_ratio(F.col("x")), special.normal_cdf_moment_ratio(2, F.col("x")), special.normal_cdf_moment_ratio(3, F.col("x"))).collect()
    with localcontext() as context:
        context.prec = 60
        for (key, value), pair in zip(rows, nearest, strict=True):
            x = Decimal((value - 50.0) / 90.7)
            total, term, n = Decimal(0), x, 0
            while term > total * Decimal(10) ** -50:
                total, n = total + term, n + 1
                term *= x * x / (2 * n + 1)
            ratio = (x * x / 2).exp() * Decimal("2.50662827463100050241576528481104525300698674060993831663") / 2 + total
            second = (x * (x * ratio + 1) + ratio) / 2
            third = (x * second + (x * ratio + 1)) / 3
            assert list(pair) == [float(ratio), float(second), float(third)], value
            r = got[key]
            assert (r.ratio, r.second_moment) == (round(float(ratio), 5), round(float(second), 4)), value
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for key, _, *want in con.execute(f"SELECT event_id, value, log_cdf, extended FROM ({workload.SQL['normal_functions']}) JOIN events USING (event_id) WHERE value < 700").fetchall():
        zeros = [got[key].log_cdf, got[key].extended]
        assert zeros == want and [math.copysign(1, v) for v in zeros] == [math.copysign(1, v) for v in want] == [-1, -1]


def test_signed_round(spark):
    df = spark.createDataFrame([(v,) for v in (-3e-7, 3e-7, 0.0, -1.2345675, 1.2345675, float("-inf"), float("nan"), None)], "v double")
    got = [r[0] for r in df.select(scalar.signed_round(F.col("v"), 6)).collect()]
    assert got[:6] == [0.0, 0.0, 0.0, -1.234568, 1.234568, float("-inf")] and math.isnan(got[6]) and got[7] is None
    assert [math.copysign(1, v) for v in got[:3]] == [-1, 1, 1]


def test_chain_equals_enumeration(spark):
    like, t, prior = [[0.9, 0.2], [0.1, 0.7], [0.5, 0.4]], [[0.7, 0.3], [0.4, 0.6]], [0.5, 0.5]
    df = spark.createDataFrame([(1, k, *v) for k, v in enumerate(like)], "s int, k int, a double, b double")
    r = messages.forward(df, "s", ["k"], [F.col("a"), F.col("b")], t, prior).first()
    joint = {}
    for path in [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]:
        p = prior[path[0]] * like[0][path[0]]
        for n in (1, 2):
            p *= t[path[n - 1]][path[n]] * like[n][path[n]]
        joint[path] = p
    z = sum(joint.values())
    assert r.log_evidence == pytest.approx(math.log(z)) and r.p[1] == pytest.approx(sum(p for q, p in joint.items() if q[2]) / z)


def test_auc_without_both_classes_is_null(spark):
    df = spark.createDataFrame([(True, 0.5), (True, 0.7)], "y boolean, s double")
    assert metrics.area_under_roc(df, [], F.col("y"), F.col("s")).first()[0] is None


def test_classifier_separates(spark):
    df = spark.range(2000).select(((F.col("id") % 41) / 20.0 - 1.0).alias("a"), ((F.col("id") % 37) / 18.0 - 1.0).alias("b")).withColumn("y", (F.col("a") * 2 - F.col("b") > 0).cast("int"))
    weights = classifier.train(df, ["a", "b"], "y")
    got = classifier.predict(df, weights)
    assert got.where((F.col("p") > 0.5) == (F.col("y") == 1)).count() >= 1900
    folds = classifier.cross_validation_folds(df.withColumn("k", F.monotonically_increasing_id()), "k", 3)
    assert sorted(r["count"] for r in folds.groupBy("fold").count().collect()) == [666, 666, 668]


def test_mixture_finds_components(spark):
    df = spark.range(1000).select("id", (F.when(F.col("id") % 4 == 0, 10.0).otherwise(0.0) + (F.col("id") % 7) / 7.0).alias("x"))
    got = sorted(mixture.fit(df, "id", F.col("x"), [(0.5, 1.0, 4.0), (0.5, 6.0, 4.0)]), key=lambda c: c[1])
    assert got[0][0] == pytest.approx(0.75, abs=0.01) and got[1][1] == pytest.approx(10.43, abs=0.05)


def test_gaussian_process_follows_data(spark):
    df = spark.createDataFrame([("k", float(x), math.sin(x)) for x in range(7)] * 20, "k string, x double, y double")
    r = {v.at: v for v in linear_algebra.gaussian_process(df, "k", "x", "y", [2.0, 30.0], 0.01).collect()}
    assert r[2.0].mean == pytest.approx(math.sin(2.0), abs=0.01) and r[30.0].variance == pytest.approx(1.0)


def test_all_dimensions_count(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("label", "embedding").collect()
    x = np.array([r.embedding for r in rows], float)
    got = workload.QUERIES["matrix_product"](spark, small).collect()
    product = x.T @ x
    assert len(got) == x.shape[1] ** 2 and all(r.v == pytest.approx(product[r.i, r.j], abs=1e-3) for r in got)
    got = workload.QUERIES["vector_covariance"](spark, small).collect()
    want = {label: np.cov(x[[r.label == label for r in rows]].T, bias=True) for label in {r.label for r in rows}}
    assert len(got) == len(want) * x.shape[1] * (x.shape[1] + 1) // 2
    assert all(r.covariance == pytest.approx(want[r.label][r.i, r.j], abs=2e-6) for r in got)
    odd = [("a", [1e6 + k, float(k * k), None if k == 3 else 2.0 * k]) for k in range(9)] + [("a", None), ("a", [1e6]), (None, [1.0])]
    df = spark.createDataFrame(odd, "label string, embedding array<double>").repartition(3)
    cells = {(r.label, r.i, r.j): r.covariance for r in linear_algebra.covariances(df, "label", "embedding").collect()}
    ks = np.array([k for k in range(9) if k != 3], float)
    assert cells["a", 0, 2] == pytest.approx(np.cov(ks, 2 * ks, bias=True)[0, 1]) and cells[None, 0, 0] == 0 and len(cells) == 7


def test_every_user_gets_the_negatives_owed(spark):
    rated = {u: set(range(u % 90 + 1)) for u in range(70)} | {500: set(range(199)), 501: set(range(200)), 502: set(range(120))}
    df = spark.createDataFrame([(u, i, 5) for u, items in rated.items() for i in items], "user long, item long, rating long")
    got = [tuple(r) for r in recommender.histogram_negatives(df).collect()]
    assert len(set(got)) == len(got) and not any(i in rated[u] for u, i in got)
    found = {u: sum(v == u for v, _ in got) for u in rated}
    assert found == {u: min(len(items), 200 - len(items)) for u, items in rated.items()}
    assert {i for _, i in got} - set(range(50))
    assert sorted(got) == sorted(tuple(r) for r in recommender.histogram_negatives(df.repartition(7)).collect())


def test_formats(spark, tmp_path):
    (tmp_path / "r.txt").write_text("# a comment\nR,0,5\nU,u1,1:0.5|2:1\nI,i1,\nu1,i1,4\nu1,i2,2.5\n")
    got = formats.read_recommender(spark, str(tmp_path / "r.txt"))
    assert {(r.user, r.item, r.rating) for r in got["ratings"].collect()} == {("u1", "i1", 4.0), ("u1", "i2", 2.5)}
    assert {(r.id, r.feature, r.value) for r in got["users"].collect()} == {("u1", "1", 0.5), ("u1", "2", 1.0)}
    assert [tuple(r) for r in got["items"].collect()] == [("i1", None, None)] and tuple(got["range"].first()) == (0.0, 5.0)
    (tmp_path / "l.txt").write_text("yes a:1 b:2.5\nno 3 4\nnone\n")
    assert {r.label: r.features for r in formats.read_labelled(spark, str(tmp_path / "l.txt")).collect()} == {"yes": {"a": 1.0, "b": 2.5}, "no": {"0": 3.0, "1": 4.0}, "none": {}}
    formats.write_ratings(got["ratings"], str(tmp_path / "out"))
    assert formats.read_ratings(spark, str(tmp_path / "out")).count() == 2
    formats.write_ranked(spark.createDataFrame([(1, "b", 2), (1, "a", 1)], "q int, item string, place int"), str(tmp_path / "ranked"), "q", "item", "place")
    assert spark.read.text(str(tmp_path / "ranked")).first()[0] == "1,a,b"


def test_stream_equals_batch(spark, small, tmp_path):
    source = spark.read.parquet(f"{small}/events.parquet").select("user_id", "value", "ts")
    source.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running = posterior.statistics(stream, "user_id", "value")
    q = running.writeStream.format("memory").queryName("stats").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    show = lambda df: sorted(tuple(round(v, 6) for v in r) for r in posterior.posterior(df, "user_id", 50.0, 100.0, 25.0).collect())
    assert show(spark.table("stats")) == show(posterior.statistics(source, "user_id", "value"))
    timed = posterior.windowed_rate(stream, "ts", "user_id", "1 day", "1 hour")
    q = timed.writeStream.format("memory").queryName("rates").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_entry_points(spark, small):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 5


def test_negatives_read_their_ratings_once(spark):
    read = spark.sparkContext.accumulator(0)
    pairs = [(u, i, 5) for u in range(40) for i in range(u % 7, 60, u % 5 + 2)]

    def seen(row):
        read.add(1)
        return row

    df = spark.createDataFrame(spark.sparkContext.parallelize(pairs, 3).map(seen), "user long, item long, rating long")
    found = [tuple(r) for r in recommender.histogram_negatives(df).collect()]
    assert read.value == len(pairs)
    assert len(set(found)) == len(found) and not {(u, i) for u, i, _ in pairs} & set(found)
