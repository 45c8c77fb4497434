"""Learners, automata, numerics, samplers, declared graphs, commands and files against plain Python and numpy."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmaplate import cli
from sigmaplate.functions import scalar, special
from sigmaplate.learners import classifier, recommender
from sigmaplate.operators import automata, estimators, factor_messages, factors, metrics, models, numerics, relational, samplers, strings
from sigmaplate.plans.graph import Graph, register
from sigmaplate.sources import matlab, persistence, tables


def curve(spark, rows, positives):
    df = spark.createDataFrame([(k, float(s), k in positives) for k, s in rows], "k long, s double, y boolean")
    return df, F.col("y"), F.col("s")


def test_known_metric_values(spark):
    df, y, s = curve(spark, [(3, 1), (1, 0.5), (2, 0.25), (4, 0)], {1, 2})
    got = [(r.precision, r.recall) for r in metrics.precision_recall_curve(df, [], y, s, F.col("k")).orderBy(F.col("score").desc_nulls_first()).collect()]
    assert got == [(1, 0), (0, 0), (0.5, 0.5), (pytest.approx(2 / 3), 1), (0.5, 1)]
    got = [(r.fpr, r.tpr) for r in metrics.roc_curve(df, [], y, s).orderBy(F.col("score").desc_nulls_first()).collect()]
    assert got == [(0, 0), (0.5, 0), (0.5, 0.5), (0.5, 1), (1, 1)]
    ties, y, s = curve(spark, [(k, 0.5) for k in range(200)] + [(900, 0.9)], {3, 900})
    points = metrics.precision_recall_curve(ties, [], y, s, F.col("k")).orderBy(F.col("score").desc_nulls_first(), F.col("tie") % 64, "tie").collect()
    assert len(points) == 202 and points[1].precision == 1 and points[-1].recall == 1 and points[-1].precision == pytest.approx(2 / 201)
    for gains in ([3, 1, 2, 2], [20, 30], [0.5, 0.9], [7.5]):
        df = spark.createDataFrame([(1, k, float(g)) for k, g in enumerate(gains)], "u int, k int, g double")
        want = sum(sum(min(g, h) for h in gains[: i + 1]) / (i + 1) for i, g in enumerate(gains)) / sum(gains)
        assert metrics.graded_average_precision(df, "u", F.col("g"), [F.col("k")]).first().gap == pytest.approx(want)
    one = spark.createDataFrame([("a", 1.0, 2.0)], "t string, a double, b double")
    assert math.isnan(metrics.hand_till(one, "t", {"a": F.col("a"), "b": F.col("b")}).first()[0])


def test_variance_of_large_means(spark):
    df = spark.createDataFrame([(1e9 + k % 3, float(1 + k % 2)) for k in range(60)], "x double, w double")
    for weight in (None, F.col("w")):
        assert estimators.moments(df, [], F.col("x"), weight).first().variance == pytest.approx(2 / 3, rel=1e-6)


def test_small_weights_keep_their_product(spark):
    a = spark.createDataFrame([("x", -500.0), ("y", -501.0)], "v string, logp double")
    got = {r.v: r.logp for r in strings.product(a, a, "v").collect()}
    assert got["x"] == pytest.approx(-math.log1p(math.exp(-2))) and got["y"] - got["x"] == pytest.approx(-2)


def test_truncation_in_the_far_tail(spark):
    got = [spark.range(1).select(factors.truncated_moments(F.lit(m), F.lit(1.0), *b).alias("t")).select("t.*").first() for m, b in ((-40.0, (0.0, None)), (45.0, (None, 0.0)), (-40.0, (0.0, 1.0)))]
    assert got[0].mean == pytest.approx(1 / 40, rel=2e-3) and got[0].variance == pytest.approx(1 / 1600, rel=5e-3) and got[0].log_probability == pytest.approx(-804.608, abs=1e-2)
    assert got[1].mean == pytest.approx(-1 / 45, rel=2e-3) and got[2].mean == pytest.approx(got[0].mean, rel=1e-9)


GRID = np.linspace(-40, 40, 800_001)


def test_special_functions_by_integration(spark):
    h = GRID[1] - GRID[0]
    bell = np.exp(-GRID * GRID / 2) / math.sqrt(2 * math.pi)
    xs = [-9.0, -4.0, -1.2, -0.1, 0.0, 0.7, 2.0, 5.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    x = F.col("x")
    rows = df.select(
        "x", special.normal_cdf_ln(x).alias("ln"), special.normal_cdf_ratio(x).alias("ratio"), special.normal_cdf_moment_ratio(3, x).alias("third"), scalar.erfc(x).alias("erfc"),
        special.normal_cdf_ratio_diff(x, F.lit(0.01)).alias("step"), special.normal_cdf_moment_ratio_diff(1, x, F.lit(0.01)).alias("step1"), special.tetragamma(F.abs(x) + 0.4).alias("tetra"),
        special.erfc_inverse(scalar.erfc(x / 4.0)).alias("back"), special.logistic_gaussian(x, F.lit(2.0)).alias("lg"), special.gamma(x + 0.3).alias("gamma"), special.log_gamma_upper(F.lit(2.5), F.abs(x) + 0.1).alias("upper"),
        special.beta_prob_less(F.lit(2.0), F.lit(3.0), F.abs(x) / 10.0).alias("beta"), special.normal_cdf_integral(x, F.lit(0.4), F.lit(0.6)).alias("integral"),
    ).collect()
    t = GRID[GRID >= 0]
    for r in rows:
        w = np.exp(r.x * t - t * t / 2)
        w[0] /= 2
        assert math.exp(r.ln) == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), rel=1e-10) and r.erfc == pytest.approx(math.erfc(r.x), rel=1e-12)
        assert r.ratio == pytest.approx(w.sum() * h, rel=1e-7) and r.third == pytest.approx((w * t**3).sum() * h / 6, rel=1e-6)
        ratio = lambda v: 0.5 * math.erfc(-v / math.sqrt(2)) * math.sqrt(2 * math.pi) * math.exp(v * v / 2)
        assert r.step == pytest.approx(ratio(r.x + 0.01) - ratio(r.x), rel=1e-5, abs=1e-9)
        assert r.step1 == pytest.approx((r.x + 0.01) * ratio(r.x + 0.01) - r.x * ratio(r.x), rel=1e-3, abs=1e-6)
        a = abs(r.x) + 0.4
        assert r.tetra == pytest.approx(-2 * sum(1 / (a + k) ** 3 for k in range(200_000)), rel=1e-5)
        assert r.back == pytest.approx(r.x / 4, abs=1e-12)
        assert r.lg == pytest.approx(((bell / (1 + np.exp(-(r.x + math.sqrt(2) * GRID)))).sum() * h), abs=1e-8)
        assert r.gamma == pytest.approx(math.gamma(r.x + 0.3), rel=1e-9)
        u = np.linspace(abs(r.x) + 0.1, 60, 600_001)
        assert r.upper == pytest.approx(math.log((u**1.5 * np.exp(-u)).sum() * (u[1] - u[0])), abs=1e-4)
        z = abs(r.x) / 10
        assert r.beta == pytest.approx(12 * (z**2 / 2 - 2 * z**3 / 3 + z**4 / 4), abs=1e-9)
        s = GRID[(GRID <= r.x)]
        inner = (r.x - s) * np.exp(-s * s / 2) / math.sqrt(2 * math.pi) * np.array([0.5]) * np.vectorize(math.erfc)(-(0.4 - 0.6 * s) / 0.8 / math.sqrt(2)) if r.x < -3 else None
        assert inner is None or r.integral == pytest.approx(inner.sum() * h, rel=1e-4, abs=1e-12)


def test_greater_and_max_messages_by_integration(spark):
    a, va, b, vb = 0.5, 1.5, 1.0, 0.8
    g = np.linspace(-9, 9, 1801)
    pa, pb = (np.exp(-((g - m) ** 2) / (2 * v)) / math.sqrt(2 * math.pi * v) for m, v in ((a, va), (b, vb)))
    joint = pa[:, None] * pb[None, :] * ((g[:, None] > g[None, :]) + 0.5 * (g[:, None] == g[None, :]))
    args = [F.lit(x) for x in (a, va, b, vb)]
    r = spark.range(1).select(factor_messages.greater_posteriors(*args).alias("g")).select("g.*").first()
    z = joint.sum()
    m = (joint.sum(1) * g).sum() / z
    assert r.mean_a == pytest.approx(m, abs=1e-3) and r.variance_a == pytest.approx((joint.sum(1) * (g - m) ** 2).sum() / z, abs=1e-3)
    assert math.exp(r.log_evidence) == pytest.approx(z * 0.01**2, abs=1e-3)
    top = np.maximum(g[:, None], g[None, :])
    joint = pa[:, None] * pb[None, :] * np.exp(-((top - 2.0) ** 2) / (2 * 0.6))
    r = spark.range(1).select(factor_messages.max_back(F.lit(2.0), F.lit(0.6), *args).alias("g")).select("g.*").first()
    z = joint.sum()
    m = (joint.sum(1) * g).sum() / z
    assert r.mean == pytest.approx(m, abs=1e-3) and r.variance == pytest.approx((joint.sum(1) * (g - m) ** 2).sum() / z, abs=1e-3)


def test_recommender_equals_coordinate_updates(spark):
    rng = np.random.default_rng(3)
    pairs = [(u, i, int(rng.integers(1, 6))) for u in range(12) for i in range(9) if rng.random() < 0.6]
    s = recommender.Settings(traits=2, sweeps=2)
    model = recommender.train(spark.createDataFrame(pairs, "user long, item long, rating long"), s)

    def start(n):
        place = lambda x, k: ((x * 2654435761 + k * 40503) % 1000 / 1000 - 0.5) * 0.2
        return {x: [0.0, 1.0, np.array([place(x, 1), place(x, 2)]), np.ones(2)] for x in n}

    users, items = start({p[0] for p in pairs}), start({p[1] for p in pairs})

    def update(own, other, mine, theirs):
        for x, of in own.items():
            rows = [p for p in pairs if p[mine] == x]
            t = np.array([other[p[theirs]][2] for p in rows])
            v = np.array([other[p[theirs]][3] for p in rows])
            left = np.array([p[2] - 3.0 - other[p[theirs]][0] for p in rows])
            of[1] = 1 / (1 + len(rows))
            of[0] = of[1] * (left - t @ of[2]).sum()
            for k in range(2):
                of[3][k] = 1 / (1 + (t[:, k] ** 2 + v[:, k]).sum())
                rest = left * t[:, k] - of[0] * t[:, k] - t[:, k] * t[:, 1 - k] * of[2][1 - k]
                of[2][k] = of[3][k] * rest.sum()

    for _ in range(2):
        update(users, items, 0, 1)
        update(items, users, 1, 0)
    for table, want in ((model.users, users), (model.items, items)):
        for r in table.collect():
            w = want[r[0]]
            assert (r.bias, r.bias_variance) == (pytest.approx(w[0]), pytest.approx(w[1])) and r.traits == pytest.approx(w[2].tolist()) and r.traits_variance == pytest.approx(w[3].tolist())
    asked = spark.createDataFrame([(0, 1), (99, 1), (0, 77)], "user long, item long")
    got = {(r.user, r.item): r.p for r in recommender.predict_distribution(asked, model).collect()}
    assert len(got) == 3 and all(sum(p) == pytest.approx(1) and min(p) >= 0 for p in got.values())
    best = recommender.recommend(recommender.candidates(model, asked.where("user = 0")), model, 3).collect()
    assert [r.place for r in sorted(best, key=lambda r: r.place)] == [1, 2, 3] and len({r["item"] for r in best}) == 3
    near = recommender.related(model, spark.createDataFrame([(0,), (1,)], "user long"), "user", 2).collect()
    assert len(near) == 4 and all(r["query"] != r.other for r in near)
    u = {k: w for k, w in users.items()}
    spread = np.mean([w[3].mean() for w in items.values()])
    for r in near:
        v = 2 + ((u[r["query"]][2] - u[r.other][2]) ** 2).sum() * spread
        assert r.score == pytest.approx(-(math.log(2 * math.pi * v) + (u[r["query"]][0] - u[r.other][0]) ** 2 / v) / 2)
    for loss in ("zero_one", "absolute", "squared"):
        assert all(1 <= r.rating <= 5 for r in recommender.predict(asked, model, loss).collect())
    assert recommender.random_baseline(asked, s).where(F.abs(F.aggregate("p", F.lit(0.0), lambda t, v: t + v) - 1) < 1e-9).count() == 3
    prior = recommender.feature_prior(spark.createDataFrame([(0, "f", 2.0), (0, "g", 1.0)], "user long, feature string, value double"), spark.createDataFrame([("f", 0.5, [1.0, 0.0]), ("g", 1.0, [0.0, 3.0])], "feature string, bias double, traits array<double>"), "user", 2)
    assert tuple(prior.first()) == (0, 2.0, [2.0, 3.0])


def test_classifier_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2))
    y = (x @ [1.5, -1.0] + 0.3 + rng.normal(size=400) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c), "pqr"[int(a > 0) + int(b > 0)]) for (a, b), c in zip(x, y)], "a double, b double, y int, z string").repartition(5)
    got = classifier.train(df, ["a", "b"], "y", sweeps=7)
    design, sign = np.column_stack([x, np.ones(400)]), np.where(y == 1, 1.0, -1.0)
    covariance, mean = np.linalg.inv(np.eye(3) + design.T @ design), np.zeros(3)
    for _ in range(7):
        m = design @ mean
        slope = np.exp(-m * m / 2) / math.sqrt(2 * math.pi) / (0.5 * np.vectorize(math.erfc)(-sign * m / math.sqrt(2)))
        mean = covariance @ design.T @ (m + sign * slope)
    assert got.mean == pytest.approx(mean) and got.covariance == pytest.approx(covariance)
    assert all(b > a for a, b in itertools.pairwise(got.evidence)) and list(got.moved) == sorted(got.moved, reverse=True)
    right = classifier.predict(df, got).where((F.col("p") > 0.5) == (F.col("y") == 1)).count()
    assert right > 320
    more = classifier.train(df, ["a", "b"], "y", sweeps=30, prior=got)
    assert np.trace(more.covariance) < np.trace(got.covariance)
    many = classifier.predict_multiclass(df, classifier.train_multiclass(df, ["a", "b"], "z", ["p", "q", "r"]))
    assert many.where(F.col("predicted") == F.col("z")).count() > 220
    assert all(sum(r.p.values()) == pytest.approx(1) for r in many.collect())
    report = classifier.cross_validate(df.withColumn("k", F.monotonically_increasing_id()), ["a", "b"], "y", "k", 3).collect()
    assert sum(r.n for r in report) == 400 and all(r.accuracy > 0.7 for r in report)
    assert classifier.sample_weights(got, 5000).mean(0) == pytest.approx(mean, abs=0.02)


def test_row_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(float((k * 37) % 101), k) for k in range(1000)] + [(None, 5000)], "x double, k long").repartition(6)
    rows = classifier.numbered(df, ["x", "k"]).orderBy("number").collect()
    assert [r.number for r in rows] == list(range(1001)) and [(r.x is not None, r.x, r.k) for r in rows] == sorted((r.x is not None, r.x, r.k) for r in rows)


# Declared graphs


def test_a_tree_is_exact(spark):
    orders = [(k, k % 4, float(10 + (k * 7) % 13)) for k in range(20)]
    rows = spark.createDataFrame(orders, "k long, c long, y double").withColumn("noise", F.lit(2.0))
    links = spark.createDataFrame([(c, c % 2) for c in range(4)], "c long, n long").withColumn("noise", F.lit(3.0))
    g = Graph().variable("nation", links.select("n").distinct(), "n", 5.0, 10.0).variable("customer", links, "c", 0.0, 1e12)
    g.factor("gaussian", links, "c", x=("customer", "c"), mean=("nation", "n")).factor("observed", rows, "k", mean=("customer", "c"))
    got = g.run(3)
    # The joint Gaussian of 2 nations and 4 customers.
    prec, tau = np.zeros((6, 6)), np.zeros(6)
    for n in range(2):
        prec[n, n] += 1 / 10
        tau[n] += 5 / 10
    for c in range(4):
        n = c % 2
        for i, j, s in ((n, n, 1), (2 + c, 2 + c, 1), (n, 2 + c, -1), (2 + c, n, -1)):
            prec[i, j] += s / 3
        prec[2 + c, 2 + c] += 1e-12
    for _, c, y in orders:
        prec[2 + c, 2 + c] += 1 / 2
        tau[2 + c] += y / 2
    cov = np.linalg.inv(prec)
    mean = cov @ tau
    for name, base in (("nation", 0), ("customer", 2)):
        for r in got[name].collect():
            assert (r["mean"], r.variance) == (pytest.approx(mean[base + r.key]), pytest.approx(cov[base + r.key, base + r.key]))
    assert g.change(got, g.run(1)) < 1e-9


def test_skills_and_user_factors(spark, tmp_path):
    games = spark.createDataFrame([(0, 1, 2), (1, 2, 3), (2, 1, 3), (3, 3, 2)], "k long, winner long, loser long").withColumn("noise", F.lit(1.0))
    players = spark.createDataFrame([(p,) for p in (1, 2, 3)], "player long")
    g = Graph().variable("skill", players, "player", 0.0, 9.0).factor("greater", games, "k", a=("skill", "winner"), b=("skill", "loser"))
    got = {r.key: r["mean"] for r in g.run(1, trace=str(tmp_path / "trace"))["skill"].collect()}
    one = {r.player: r["mean"] for r in models.skill_round(games.select("winner", "loser"), players.select("player", F.lit(0.0).alias("mean"), F.lit(9.0).alias("variance")), 1.0).collect()}
    assert got == {k: pytest.approx(v) for k, v in one.items()} and got[1] > got[2] and got[1] > got[3]
    assert spark.read.parquet(str(tmp_path / "trace")).count() == 4
    later = {r.key: r["mean"] for r in g.run(5, damping=0.2)["skill"].collect()}
    assert later[1] > later[2] > later[3] - 1

    @register("twice", ("x",))
    def twice(c):
        return {"x": (F.col("y") * 2.0, F.lit(4.0))}

    h = Graph().variable("v", players, "player", 1.0, 0.5).factor("twice", games.select("k", "winner", F.lit(3.0).alias("y")).where("k = 0"), "k", x=("v", "winner"))
    h.passes.append(lambda fs: fs)
    r = {x.key: x for x in h.run(1)["v"].collect()}
    assert r[1]["mean"] == pytest.approx((2 + 6) / 6) and r[2]["mean"] == 1
    sure = Graph().variable("v", players, "player", -1.0, 4.0).factor("positive", players, "player", x=("v", "player")).run(1)["v"].first()
    w = np.exp(-((GRID + 1) ** 2) / 8) * (GRID > 0)
    assert sure["mean"] == pytest.approx((w * GRID).sum() / w.sum(), abs=1e-4)
    with pytest.raises(ValueError):
        Graph().factor("greater", games, "k", a=("skill", "winner"))


# Automata


def texts(alphabet, most):
    return ["".join(t) for n in range(most + 1) for t in itertools.product(alphabet, repeat=n)]


def test_automata_against_enumeration():
    A, C = automata.Automaton, automata.Chars
    a, b = A.element(C.of("a"), math.log(0.5)), A.element(C.of("ab"), math.log(0.2))
    e = math.exp
    for t in texts("ab", 4):
        ones = [0.5 if c == "a" else 0 for c in t]
        twos = [0.2] * len(t)
        assert e((a.repeat() + b.repeat()).log_value(t)) == pytest.approx(sum(np.prod(ones[:k]) * np.prod(twos[k:]) for k in range(len(t) + 1)))
        assert e((a | b).log_value(t)) == pytest.approx(ones[0] + twos[0] if len(t) == 1 else 0)
        product = a.repeat(1) * b.repeat()
        assert e(product.log_value(t)) == pytest.approx(np.prod(ones) * np.prod(twos) if t else 0)
        assert e((a + b + A.constant("b")).reverse().log_value(t[::-1])) == pytest.approx(e((a + b + A.constant("b")).log_value(t)))
        d = (a.repeat() + b.repeat(0, 2) | A.constant("ab")).determinized()
        assert d.is_deterministic() and e(d.log_value(t)) == pytest.approx(e((a.repeat() + b.repeat(0, 2) | A.constant("ab")).log_value(t)))
    assert not (a | b).is_deterministic() and e(a.repeat().log_normalizer()) == pytest.approx(2.0)
    assert e(b.repeat(0, 3).log_normalizer()) == pytest.approx(sum(0.4**k for k in range(4)))
    assert A.element(C.of("a")).repeat().log_normalizer(50) == math.inf
    assert e(b.repeat(1, 3).normalized().log_normalizer()) == pytest.approx(1)
    trie = A.from_values({"no": 0.0, "none": -1.0, "": -2.0})
    assert dict(trie.support()) == {"": -2.0, "no": 0.0, "none": -1.0} and trie.point() is None and A.constant("x").point() == "x"
    assert list(A.zero().support()) == [] and A.zero().log_value("") == -math.inf and A.empty(-1.0).log_value("") == -1.0
    assert len((A.constant("abc") * A.constant("abd")).simplified().ends) == 1
    loop = A.empty()
    loop.arc(0, None, 0, math.log(0.5))
    assert e(loop.log_value("")) == pytest.approx(2.0)
    digits = automata.DIGITS
    assert "5" in digits and "a" not in digits and "a" in digits.complement() and len(automata.LETTERS_OR_DIGITS) == 62 and list(C.of("ca") | C.of("b")) == ["a", "b", "c"]
    assert len(C.of("x").complement()) + 1 == len(automata.ANY) and a.optional().log_value("") == 0.0


def test_transducers():
    T, A, C = automata.Transducer, automata.Automaton, automata.Chars
    spell = (T.copying(A.element(C.of("-").complement())) | T.replace("-", " minus ")).repeat()
    assert [w for w, _ in spell.project("3-4").support()] == ["3 minus 4"] and spell.log_value("3-4", "3-4") == -math.inf
    either = T.replace("a", "x") | T.replace("a", "yy")
    assert {w for w, _ in (either + either).project("aa").support()} == {"xx", "xyy", "yyx", "yyyy"}
    drop = T.consume(A.element(automata.DIGITS).repeat(1)) + T.produce("#")
    assert drop.log_value("123", "#") == 0.0 and drop.log_value("12a", "#") == -math.inf


# Numerics, samplers, sources


def test_search_and_factors(spark):
    f = lambda x: (float((x[0] - 1) ** 2 + 10 * (x[1] - x[0] ** 2) ** 2), np.array([2 * (x[0] - 1) - 40 * x[0] * (x[1] - x[0] ** 2), 20 * (x[1] - x[0] ** 2)]))
    assert numerics.lbfgs(f, np.array([-1.0, 2.0])) == pytest.approx([1, 1], abs=1e-5)
    bound = lambda box: max(-((min(max(0.3, lo), hi) - 0.3) ** 2) for lo, hi in box[:1]) - sum(0 if lo <= 2 <= hi else min((lo - 2) ** 2, (hi - 2) ** 2) for lo, hi in box[1:])
    assert numerics.branch_and_bound(bound, [(-5, 5), (0, 9)]) == pytest.approx([0.3, 2.0], abs=2e-3)
    a = np.array([[0.0, 2, 1], [4, 1, 1], [2, 5, 3]])
    order, low, up = numerics.lu(a)
    assert low @ up == pytest.approx(a[order])
    assert numerics.clenshaw_curtis(lambda t: np.exp(-t * t / 2)) == pytest.approx(math.sqrt(2 * math.pi))
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-x @ [2, -1]))).astype(float)
    df = spark.createDataFrame([(float(p), float(q), float(r)) for (p, q), r in zip(x, y)], "p double, q double, y double")
    w = numerics.lbfgs(numerics.logistic_objective(df, ["p", "q"], "y"), np.zeros(2), steps=15, tolerance=1e-4)
    assert x.T @ (1 / (1 + np.exp(-x @ w)) - y) + w == pytest.approx([0, 0], abs=1e-2)
    e = spark.range(1).select(numerics.extended_sum(special.extended(F.lit(800.5)), special.extended(F.lit(799.0))).alias("s"), numerics.extended_product(special.extended(F.lit(800.5)), special.extended(F.lit(2.0))).alias("p"))
    e = e.select(numerics.extended_log(F.col("s")).alias("s"), numerics.extended_log(F.col("p")).alias("p")).first()
    assert e.s == pytest.approx(800.5 + math.log1p(math.exp(-1.5))) and e.p == pytest.approx(802.5)


def test_samplers_have_their_moments(spark):
    df = spark.range(20_000).select("id", F.lit(3.0).alias("a"), F.lit(2.0).alias("b"), F.array(*map(F.lit, (0.2, 0.5, 0.3))).alias("p"), F.lit(6).alias("n"), F.array(F.lit(1.0), F.lit(-1.0)).alias("m"), F.array(*map(F.lit, (2.0, 0.5, 0.5, 1.0))).alias("c"), F.lit(5.0).alias("dof"))
    k = F.col("id")
    each = df.select(
        samplers.uniform(k).alias("u"), samplers.normal(k, F.lit(1.0), F.lit(4.0)).alias("n"), samplers.normal_greater_than(k, F.lit(2.0)).alias("g"), samplers.exponential(k, F.lit(4.0)).alias("e"),
        samplers.discrete(k, F.col("p")).alias("d"), samplers.uniform_between(k, F.lit(2.0), F.lit(6.0)).alias("b"), samplers.uniform(k, 1).alias("u1"), samplers.uniform(k, 2).alias("u2"),
    )
    r = each.agg(
        F.avg("u"), F.var_pop("u"), F.avg("n"), F.var_pop("n"), F.min("g"), F.avg("g"), F.avg("e"), F.avg((F.col("d") == 1).cast("double")), F.avg("b"), F.corr("u1", "u2")
    ).first()
    assert list(r) == [pytest.approx(v, abs=t) for v, t in ((0.5, 0.01), (1 / 12, 0.003), (1, 0.05), (4, 0.15), (2, 0.01), (2.373, 0.02), (0.25, 0.01), (0.5, 0.02), (4, 0.04), (0, 0.03))]
    small = df.where("id < 4000")
    mean = lambda d, c="sample": d.agg(F.avg(c)).first()[0]
    assert mean(samplers.gamma(small, "id", "a", "b")) == pytest.approx(1.5, abs=0.06) and mean(samplers.beta(small, "id", "a", "b")) == pytest.approx(0.6, abs=0.02)
    assert mean(samplers.poisson(small, "id", "a")) == pytest.approx(3, abs=0.12) and mean(samplers.binomial(small.withColumn("q", F.lit(0.3)), "id", "n", "q")) == pytest.approx(1.8, abs=0.08)
    at = lambda d, i: d.select(F.col("sample")[i].alias("v")).agg(F.avg("v")).first()[0]
    assert at(samplers.dirichlet(small, "id", "p"), 1) == pytest.approx(0.5, abs=0.03) and at(samplers.multinomial(small, "id", "n", "p"), 1) == pytest.approx(3, abs=0.1)
    assert at(samplers.vector_normal(small, "id", "m", "c"), 1) == pytest.approx(-1, abs=0.06) and at(samplers.wishart(small, "id", "dof", "c"), 1) == pytest.approx(2.5, abs=0.2)
    assert sorted(map(repr, samplers.gamma(small, "id", "a", "b").collect())) == sorted(map(repr, samplers.gamma(small.repartition(7), "id", "a", "b").collect()))
    assert samplers.without_replacement(df, k, 7).count() == 7 and sorted(r.id for r in samplers.shuffled(df, k).collect()) == list(range(20_000))


def test_matlab_files(spark, tmp_path):
    a = np.arange(6.0).reshape(2, 3) / 7
    data = matlab.write({"a": a, "name": "text é", "s": np.array([[2.5]])})
    back = matlab.read(data)
    assert (back["a"] == a).all() and back["name"] == "text é" and back["s"] == 2.5
    (tmp_path / "x.mat").write_bytes(data)
    cells = {(r.name, r.i, r.j): r.v for r in matlab.read_files(spark, str(tmp_path)).collect()}
    assert cells["a", 1, 2] == a[1, 2] and len(cells) == 7


def test_tables_of_a_dataset(spark, tmp_path):
    ratings = spark.createDataFrame([("u1", "i1", 4), ("u2", "i1", 2), ("u1", "i2", 5)], "user string, item string, rating int")
    items = spark.createDataFrame([("i1", "colour", "1")], "item string, feature string, value string")
    users = spark.createDataFrame([("u2", "age", "0.5"), ("u2", "colour", "2")], "user string, feature string, value string")
    got = tables.normalised(ratings, items, users)
    assert {n: t.count() for n, t in got.items()} == {"Feature": 2, "Item": 2, "User": 2, "ItemFeature": 1, "UserFeature": 2, "UserItemRating": 3}
    assert got["ItemFeature"].first().FeatureValue == "1" and sorted(r.ID for r in got["Item"].collect()) == [0, 1]
    tables.write_dataset(ratings, items, users, str(tmp_path / "d"), 1, 5)
    from sigmaplate.sources import formats

    back = formats.read_recommender(spark, str(tmp_path / "d"))
    assert back["ratings"].count() == 3 and back["users"].count() == 2 and tuple(back["range"].first()) == (1.0, 5.0)
    tables.create(spark, "recsys")
    assert spark.table("recsys.UserItemRating").count() == 0


def test_relational_pieces(spark):
    df = spark.createDataFrame([("a", k, float(k)) for k in range(5)] + [("b", 0, 7.0)], "k string, i int, v double")
    got = {r.k: r.result for r in relational.folded(df, "k", ["i"], "v", F.lit(0.0), lambda s, v: s * 0.5 + v).collect()}
    assert got == {"a": 0.5 * (0.5 * (0.5 * (0.5 * 0 + 1) + 2) + 3) + 4, "b": 7.0}
    assert {r.t for r in relational.all_reduced(df, ["k"], t=F.col("v")).collect()} == {10.0, 7.0}
    assert relational.scattered(df, ["k"], 3).rdd.getNumPartitions() == 3 and relational.union_of([df, df], distinct=True).count() == 6
    t = spark.createDataFrame([("a cat sat",)], "t string")
    assert t.select(strings.at_word_boundary(F.col("t"), F.lit(3), F.lit(3)).alias("x"), strings.at_word_boundary(F.col("t"), F.lit(3), F.lit(2)).alias("y")).first() == (True, False)


# Commands


def test_commands(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    run = lambda *a: cli.main([str(x) for x in a], spark)
    lines = ["R,1,5", "# ratings"] + [f"u{u},i{i},{1 + (u * i + u) % 5}" for u in range(12) for i in range(8) if (u + 2 * i) % 3]
    (tmp_path / "r.txt").write_text("\n".join(lines))
    run("recommender", "split-data", "--data", p("r.txt"), "--train", p("train"), "--test", p("test"), "--train-only-users", 0.3)
    assert spark.read.text(p("train")).count() + spark.read.text(p("test")).count() == len(lines) - 2
    run("recommender", "generate-negative-data", "--data", p("r.txt"), "--output", p("neg"))
    run("recommender", "train", "--data", p("r.txt"), "--model", p("m"), "--traits", 2, "--sweeps", 2)
    run("recommender", "predict-ratings", "--data", p("r.txt"), "--model", p("m"), "--predictions", p("pred"))
    run("recommender", "evaluate-rating-prediction", "--data", p("r.txt"), "--predictions", p("pred"), "--report", p("rep1"))
    assert float(spark.read.option("header", True).csv(p("rep1")).first().absolute_error) < 2
    run("recommender", "recommend-items", "--data", p("r.txt"), "--model", p("m"), "--predictions", p("rec"), "--top", 3)
    run("recommender", "evaluate-item-recommendation", "--data", p("r.txt"), "--predictions", p("rec"), "--report", p("rep2"), "--top", 3)
    for side in ("users", "items"):
        run("recommender", f"find-related-{side}", "--data", p("r.txt"), "--model", p("m"), "--predictions", p(side), "--top", 2)
        run("recommender", f"evaluate-find-related-{side}", "--data", p("r.txt"), "--predictions", p(side), "--report", p(f"rep-{side}"), "--top", 2)
        assert 0 < float(spark.read.option("header", True).csv(p(f"rep-{side}")).first().ndcg) <= 1
    rng = np.random.default_rng(6)
    assert {path[-1] for path in cli.COMMANDS if path[:2] == ("classifier", "multiclass")} == {path[-1] for path in cli.COMMANDS if path[:2] == ("classifier", "binary")}
    rows = [f"{'yes' if a + 0.3 * rng.normal() > 0 else 'no'} a:{a:.3f} b:{b:.3f}" for a, b in rng.normal(size=(200, 2))]
    (tmp_path / "c.txt").write_text("\n".join(rows))
    for kind in ("binary", "multiclass"):
        run("classifier", kind, "train", "--data", p("c.txt"), "--model", p(kind), "--sweeps", 4)
        run("classifier", kind, "predict", "--data", p("c.txt"), "--model", p(kind), "--predictions", p(kind + "p"))
    run("classifier", "binary", "train-incremental", "--data", p("c.txt"), "--input-model", p("binary"), "--model", p("again"), "--sweeps", 2)
    run("classifier", "binary", "sample-weights", "--model", p("binary"), "--samples", p("drawn"), "--count", 4)
    run("classifier", "binary", "diagnose-train", "--data", p("c.txt"), "--report", p("trace"), "--sweeps", 2)
    run("classifier", "binary", "cross-validate", "--data", p("c.txt"), "--report", p("folds"), "--folds", 2, "--sweeps", 2)
    assert all(float(r.accuracy) > 0.8 for r in spark.read.option("header", True).csv(p("folds")).collect())
    run("classifier", "evaluate", "--data", p("c.txt"), "--predictions", p("multiclassp"), "--report", p("rep3"))
    report = {r.label: r for r in spark.read.option("header", True).csv(p("rep3")).collect()}
    assert set(report) == {"yes", "no"} and float(report["yes"].auc) > 0.9 and float(report["no"].f1) > 0.8
    assert persistence.load_classifier(spark, p("binary"))["yes"].features == ["x_a", "x_b"]


def test_topic_sweep_equals_numpy(spark):
    rng = np.random.default_rng(8)
    n = rng.integers(0, 4, (5, 6))
    rows = [(d, f"w{w}", int(n[d, w])) for d in range(5) for w in range(6) if n[d, w]]
    counts = spark.createDataFrame(rows, "d long, word string, n long")
    start = rng.dirichlet([1, 1, 1], len(rows))
    belief = spark.createDataFrame([(*r, p.tolist()) for r, p in zip(rows, start)], "d long, word string, n long, p array<double>")
    got = {(r.d, r.word): r.p for r in models.topic_sweep(counts, "d", 3, belief).collect()}
    by_row, by_word = np.full((5, 3), 0.1), np.full((6, 3), 0.01)
    for (d, w, k), p in zip(rows, start):
        by_row[d] += k * p
        by_word[int(w[1:])] += k * p
    psi = lambda x: math.log(x + 60) - 1 / (2 * (x + 60)) - 1 / (12 * (x + 60) ** 2) - sum(1 / (x + k) for k in range(60))
    seen = sorted({int(w[1:]) for _, w, _ in rows})
    totals = by_word[seen].sum(0)
    for d, w, _ in rows:
        s = np.array([psi(by_row[d][k]) + psi(by_word[int(w[1:])][k]) - psi(totals[k]) for k in range(3)])
        s = np.exp(s - s.max())
        assert got[d, w] == pytest.approx((s / s.sum()).tolist(), rel=1e-6)
    assert all(sum(p) == pytest.approx(1) for p in (r.p for r in models.topic_sweep(counts, "d", 3).collect()))


def test_principal_directions(spark):
    a = np.diag([5.0, 2.0, 1.0]) + 0.1
    rows = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(3) for j in range(3)], "i int, j int, v double")
    first = models.principal_directions(rows, 2)[0]
    values, vectors = np.linalg.eigh(a)
    assert np.abs(vectors[:, -1]) == pytest.approx(np.abs(first), abs=1e-8) and values[-1] > 5


def test_motif_places_of_shared_and_null_rows_add_up(spark):
    texts = [(1, "Stebolt"), (1, "xPao"), (None, "Ste"), (2, "St"), (3, None), (4, "größe😀Ste")]
    df = spark.createDataFrame(texts, "k long, t string").repartition(3)
    motif = [{"S": 0.6, "P": 0.2}, {"t": 0.3, "a": 0.3, "r": 0.2}, {"e": 0.5, "o": 0.2, "😀": 0.0}]
    found = models.motif_positions(df, "k", "t", motif, 0.02)
    weights = {}
    for k, t in texts:
        for i in range(len(t or "") - 2):
            weights.setdefault(k, []).append((i, np.prod([of.get(t[i + j], 1e-3) / 0.02 for j, of in enumerate(motif)])))
    want = sorted((k or 0, i, round(w / sum(w for _, w in all_), 9)) for k, all_ in weights.items() for i, w in all_)
    assert sorted((r.k or 0, r.position, round(r.p, 9)) for r in found.collect()) == want
    # Nothing is joined, so no table of all rows can be broadcast through the driver.
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
