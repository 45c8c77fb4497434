"""Variable nodes, Gibbs chains and vector factors against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmaplate.operators import matrix_messages as mm
from sigmaplate.operators import variables
from sigmaplate.variable_queries import hierarchy_chain


def test_vector_factors_equal_numpy(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k, d in enumerate((1, 2, 5, 9)):
        x, m, (a, b) = rng.normal(size=d), rng.normal(size=d), rng.normal(size=(2, d, d + 3))
        rows.append((k, x, m, a @ a.T, b @ b.T))
    df = spark.createDataFrame([(k, x.tolist(), m.tolist(), v.ravel().tolist(), r.ravel().tolist()) for k, x, m, v, r in rows], "k int, x array<double>, m array<double>, v array<double>, r array<double>")
    x, m, v, r, shape = F.col("x"), F.col("m"), F.col("v"), F.col("r"), F.lit(9.5)
    back = mm.moments(mm.natural(x, v))
    both = mm.concatenated(x, v, m, r)
    part = mm.subvector(both["mean"], both["variance"], 1, 2)
    product = mm.wishart_product(mm.precision_variational(x, v, m, r), mm.wishart_from_scale(shape, r))
    got = df.select("k", mm.swept(v).alias("s"), back.alias("back"), both.alias("both"), part.alias("part"), product.alias("product"),
                    mm.gaussian_log_average(x, m, v).alias("la"), mm.wishart_mean(mm.wishart(shape, r)).alias("mean")).collect()
    for g in got:
        _, x, m, v, r = rows[g.k]
        d = len(x)
        assert np.allclose(g.s.inverse, np.linalg.inv(v).ravel()) and g.s.log_det == pytest.approx(np.linalg.slogdet(v)[1])
        assert np.allclose(g.back.mean, x) and np.allclose(g.back.variance, v.ravel())
        whole = np.block([[v, np.zeros((d, d))], [np.zeros((d, d)), r]])
        assert np.allclose(g.both.variance, whole.ravel()) and np.allclose(g.both.mean, np.append(x, m))
        if d > 1:
            assert np.allclose(g.part.variance, whole[1:3, 1:3].ravel()) and np.allclose(g.part.mean, np.append(x, m)[1:3])
        assert g.la == pytest.approx(-0.5 * ((x - m) @ np.linalg.inv(v) @ (x - m) + np.linalg.slogdet(v)[1] + d * math.log(2 * math.pi)))
        assert np.allclose(g.mean, 9.5 * np.linalg.inv(r).ravel())
        assert g.product.shape == pytest.approx((d + 2) / 2 + 9.5 - (d + 1) / 2)
        assert np.allclose(g.product.rate, ((v + r + np.outer(x - m, x - m)) / 2 + np.linalg.inv(r)).ravel())


def test_wishart_mean_log_det_by_sampling(spark):
    rng = np.random.default_rng(5)
    rate = np.array([[2.0, 0.4], [0.4, 1.0]])
    half = np.linalg.cholesky(np.linalg.inv(2 * rate))  # 2 * shape degrees of freedom of this scale
    z = rng.normal(size=(200_000, 7, 2)) @ half.T
    dets = np.linalg.slogdet(np.einsum("nki,nkj->nij", z, z))[1]
    r = F.array(*[F.lit(v) for v in rate.ravel().tolist()])
    got = spark.range(1).select(mm.wishart_mean_log_det(mm.wishart(F.lit(3.5), r)).alias("g")).first().g
    assert got == pytest.approx(dets.mean(), abs=0.01)


def test_gibbs_finds_the_exact_posterior(spark):
    df = spark.createDataFrame([(0, 4.0, 3.0), (1, 30.0, -2.0)], "g long, n double, x double")
    kept = hierarchy_chain(F.col("x"), F.col("n"), F.col("g"), 25.0, 2.0, 9.0, 100, 1, 4000)
    got = df.select("n", "x", variables.mixed_conditionals(kept, "mean", "variance").alias("m"), F.size(kept).alias("size")).collect()
    for r in got:
        variance = 1 / (1 / 25 + 1 / (2 + 9 / r.n))
        assert r.size == 4000
        assert r.m.mean == pytest.approx(variance * r.x / (2 + 9 / r.n), abs=0.15)
        assert r.m.variance == pytest.approx(variance, rel=0.1)


def test_points_and_edges(spark):
    mode = variables.rprop(F.lit(-3.0), lambda x: F.lit(2.5) - x)
    message = F.struct(F.lit(2.0).alias("tau"), F.lit(4.0).alias("prec"))
    none = F.lit(None).cast("struct<tau:double,prec:double>")
    r = spark.range(1).select(
        mode.alias("mode"), variables.beta_point(F.lit(0.5), F.lit(2.0)).alias("low"), variables.beta_point(F.lit(1.0), F.lit(1.0)).alias("middle"), variables.beta_point(F.lit(3.0), F.lit(2.0)).alias("inside"),
        variables.gamma_point(F.lit(0.5), F.lit(2.0)).alias("zero"), variables.cut_back().alias("cut"), variables.forward_when(message, F.lit(None).cast("boolean")).alias("kept"),
        variables.initialised(none, message).alias("init"), variables.max_marginal(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(0.5), F.lit(0.0))).alias("best"),
    ).first()
    assert r.mode == pytest.approx(2.5, abs=1e-6)
    assert (r.low, r.middle, r.inside, r.zero) == (0.0, 0.5, pytest.approx(2 / 3), 0.0)
    assert (r.cut.tau, r.cut.prec, r.kept.tau, r.init.prec) == (0.0, 0.0, 2.0, 4.0)
    assert r.best == [-1.5, 0.0]


def test_added_messages(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], [3.0]), ("a", [4.0, 5.0], [6.0]), ("b", [7.0, 8.0], [9.0])], "k string, u array<double>, v array<double>")
    assert {r.k: (r.u, r.v) for r in mm.added(df, ["k"], "u", "v").collect()} == {"a": ([5.0, 7.0], [9.0]), "b": ([7.0, 8.0], [9.0])}
