"""Closed-form factors and special functions against numerical integration and identities."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmaplate.functions import scalar
from sigmaplate.operators import factors

GRID = np.linspace(-60, 60, 480_001).round(8)  # bounds lie on grid points


def density(mean, variance):
    return np.exp(-((GRID - mean) ** 2) / (2 * variance)) / math.sqrt(2 * math.pi * variance)


@pytest.mark.parametrize("bounds", [(0.0, None), (None, 1.0), (0.5, 2.0), (None, None)])
def test_truncation(spark, bounds):
    df = spark.createDataFrame([(m, v) for m in (-4.0, 0.0, 0.7, 6.0) for v in (0.5, 4.0)], "m double, v double")
    got = factors.truncated_moments(F.col("m"), F.col("v"), *bounds)
    lo, hi = (-math.inf if bounds[0] is None else bounds[0]), (math.inf if bounds[1] is None else bounds[1])
    for r in df.select("m", "v", got.alias("t")).select("m", "v", "t.*").collect():
        w = density(r.m, r.v) * (((GRID > lo) & (GRID < hi)) + 0.5 * ((GRID == lo) | (GRID == hi)))
        p = w.sum() * (GRID[1] - GRID[0])
        mean = (w * GRID).sum() / w.sum()
        assert r.probability == pytest.approx(p, rel=1e-5)
        assert r.mean == pytest.approx(mean, abs=1e-5)
        assert r.variance == pytest.approx((w * (GRID - mean) ** 2).sum() / w.sum(), rel=1e-3)


def test_maximum(spark):
    args = [F.lit(x) for x in (1.0, 2.0, 1.5, 0.5)]
    r = spark.range(1).select(factors.maximum_moments(*args).alias("t"), factors.greater_probability(*args).alias("greater")).select("t.*", "greater").first()
    h = GRID[1] - GRID[0]
    a, b = density(1.0, 2.0), density(1.5, 0.5)
    top = a * np.cumsum(b) * h + b * np.cumsum(a) * h
    mean = (top * GRID).sum() * h
    assert r.mean == pytest.approx(mean, abs=1e-3)
    assert r.variance == pytest.approx((top * (GRID - mean) ** 2).sum() * h, abs=2e-3)
    assert r.greater == pytest.approx((a * np.cumsum(b)).sum() * h * h, abs=1e-3)


def test_logic_equals_enumeration(spark):
    r = spark.range(1).select(
        factors.all_of_message(F.lit(0.3), F.lit(0.6)).alias("conj"), factors.any_of_message(F.lit(0.3), F.lit(0.6)).alias("disj")
    ).first()
    for name, op in (("conj", all), ("disj", any)):
        w = {a: sum((0.6 if b else 0.4) * (0.3 if op((a, b)) else 0.7) for b in (False, True)) for a in (False, True)}
        assert r[name] == pytest.approx(w[True] / (w[True] + w[False]))


def test_inverse_and_logs(spark):
    ps = [1e-12, 1e-4, 0.02, 0.3, 0.5, 0.75, 0.9999]
    df = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, 1.5]], "p double")
    got = [r.x for r in df.select(scalar.normal_cdf_inverse(F.col("p")).alias("x")).collect()]
    assert [math.erfc(-x / math.sqrt(2)) / 2 for x in got[: len(ps)]] == pytest.approx(ps, rel=1e-8)
    assert got[len(ps) :] == [-math.inf, math.inf, None]
    r = spark.range(1).select(
        scalar.trigamma(F.lit(1.0)).alias("t"), scalar.log_difference_of_exp(F.lit(800.0), F.lit(799.0)).alias("d"),
        scalar.log1m_exp(F.lit(-1e-10)).alias("m"),
    ).first()
    assert r.t == pytest.approx(math.pi**2 / 6, rel=1e-9)
    assert r.d == pytest.approx(800 + math.log1p(-math.exp(-1)))
    assert r.m == pytest.approx(math.log(1e-10))
