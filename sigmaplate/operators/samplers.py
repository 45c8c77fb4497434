"""Reproducible random draws: hashed uniform numbers as column expressions, and numpy generators seeded by row."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bound, normal_cdf, normal_cdf_inverse

_SPAN = 4294967296


def uniform(key: Column, salt: int = 0) -> Column:
    """A number in 0..1, both excluded, for a whole-numbered key: three rounds of a multiplicative hash."""

    def mix(h: Column, k: int) -> Column:
        return F.pmod(h.bitwiseXOR(F.shiftrightunsigned(h, k)) * 1597334677, F.lit(_SPAN))

    low, high = F.pmod(key, F.lit(1 << 31)), F.pmod(F.shiftright(key.cast("long"), 31), F.lit(1 << 31))
    first = F.pmod(low * 2654435761 + high * 40503 + salt * 40503 + 1, F.lit(_SPAN))
    return bound(first, lambda h: bound(mix(h, 15), lambda h: (mix(h, 13) + 0.5) / float(_SPAN)))


def uniform_between(key: Column, lo: Column, hi: Column, salt: int = 0) -> Column:
    return lo + (hi - lo) * uniform(key, salt)


def whole_below(key: Column, n: int, salt: int = 0) -> Column:
    return F.floor(uniform(key, salt) * n)


def normal(key: Column, mean: Column, variance: Column, salt: int = 0) -> Column:
    """By the two uniform numbers of Box and Muller."""
    radius = F.sqrt(F.log(uniform(key, 2 * salt + 1)) * -2.0)
    return mean + F.sqrt(variance) * radius * F.cos(uniform(key, 2 * salt + 2) * (2 * math.pi))


def normal_between(key: Column, lo: Column, hi: Column, salt: int = 0) -> Column:
    """A standard normal between bounds, by inverting its distribution function in the nearer tail."""

    def drawn_at(g: Column) -> Column:
        return bound(g["low"] + (g["high"] - g["low"]) * uniform(key, salt), normal_cdf_inverse)

    flip = lo > 0
    a, b = F.when(flip, -hi).otherwise(lo), F.when(flip, -lo).otherwise(hi)
    x = bound(F.struct(normal_cdf(a).alias("low"), normal_cdf(b).alias("high")), drawn_at)
    return F.when(flip, -x).otherwise(x)


def normal_greater_than(key: Column, lo: Column, salt: int = 0) -> Column:
    return normal_between(key, lo, F.lit(38.0), salt)


def exponential(key: Column, rate: Column, salt: int = 0) -> Column:
    return -F.log(uniform(key, salt)) / rate


def discrete(key: Column, p: Column, salt: int = 0) -> Column:
    """A place in an array of probabilities, from 0."""
    sums = F.aggregate(p, F.array().cast("array<double>"), lambda s, v: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0)) + v)))
    place = bound(uniform(key, salt), lambda u: F.size(F.filter(sums, lambda s: s <= u)))
    return F.least(place, F.size(p) - 1)


def shuffled(data: DataFrame, key: Column, salt: int = 0) -> DataFrame:
    """data sorted by a hashed number, ranges in order: a permutation."""
    return data.withColumn("_u", uniform(key, salt)).repartitionByRange("_u").sortWithinPartitions("_u").drop("_u")


def without_replacement(data: DataFrame, key: Column, n: int, salt: int = 0) -> DataFrame:
    return data.withColumn("_u", uniform(key, salt)).orderBy("_u", key).limit(n).drop("_u")


def drawn(data: DataFrame, key: str, name: str, kind: str, draw: Callable[[np.random.Generator, dict], object], parameters: list[str], seed: int = 0) -> DataFrame:
    """data with a column drawn row by row by a generator seeded with seed and key, so that it doesn't depend on partitions."""

    def run(frames):
        for frame in frames:
            out = [draw(np.random.Generator(np.random.Philox(key=[seed, int(r[key]) & (1 << 64) - 1])), r) for r in frame.to_dict("records")]
            frame[name] = pd.Series(out, index=frame.index, dtype=object if kind.startswith("array") else None)
            yield frame

    columns = list(dict.fromkeys([key, *parameters]))
    types = dict(data.dtypes)
    return data.select(*columns).mapInPandas(run, ", ".join(f"`{c}` {types[c]}" for c in columns) + f", {name} {kind}")


def gamma(data: DataFrame, key: str, shape: str, rate: str, seed: int = 0) -> DataFrame:
    return drawn(data, key, "sample", "double", lambda g, r: float(g.gamma(r[shape]) / r[rate]), [shape, rate], seed)


def beta(data: DataFrame, key: str, a: str, b: str, seed: int = 0) -> DataFrame:
    return drawn(data, key, "sample", "double", lambda g, r: float(g.beta(r[a], r[b])), [a, b], seed)


def poisson(data: DataFrame, key: str, mean: str, seed: int = 0) -> DataFrame:
    return drawn(data, key, "sample", "long", lambda g, r: int(g.poisson(r[mean])), [mean], seed)


def binomial(data: DataFrame, key: str, n: str, p: str, seed: int = 0) -> DataFrame:
    return drawn(data, key, "sample", "long", lambda g, r: int(g.binomial(int(r[n]), r[p])), [n, p], seed)


def dirichlet(data: DataFrame, key: str, counts: str, seed: int = 0) -> DataFrame:
    return drawn(data, key, "sample", "array<double>", lambda g, r: g.dirichlet(np.asarray(r[counts], float)).tolist(), [counts], seed)


def multinomial(data: DataFrame, key: str, n: str, p: str, seed: int = 0) -> DataFrame:
    return drawn(data, key, "sample", "array<long>", lambda g, r: [int(v) for v in g.multinomial(int(r[n]), np.asarray(r[p], float))], [n, p], seed)


def vector_normal(data: DataFrame, key: str, mean: str, covariance: str, seed: int = 0) -> DataFrame:
    """covariance: a flat array of n * n."""

    def one(g: np.random.Generator, r: dict) -> list[float]:
        m = np.asarray(r[mean], float)
        return (m + np.linalg.cholesky(np.asarray(r[covariance], float).reshape(len(m), len(m))) @ g.normal(size=len(m))).tolist()

    return drawn(data, key, "sample", "array<double>", one, [mean, covariance], seed)


def wishart(data: DataFrame, key: str, dof: str, scale: str, seed: int = 0) -> DataFrame:
    """A flat n * n matrix, by Bartlett's factors; scale: a flat array of n * n."""

    def one(g: np.random.Generator, r: dict) -> list[float]:
        s = np.asarray(r[scale], float)
        n = math.isqrt(len(s))
        a = np.tril(g.normal(size=(n, n)), -1) + np.diag(np.sqrt(g.chisquare(r[dof] - np.arange(n))))
        low = np.linalg.cholesky(s.reshape(n, n)) @ a
        return (low @ low.T).ravel().tolist()

    return drawn(data, key, "sample", "array<double>", one, [dof, scale], seed)
