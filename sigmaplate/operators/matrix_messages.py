"""Messages of vector Gaussian and Wishart factors of any dimension, as column expressions.

A vector is an array, a symmetric matrix the array of its rows one after another.  A Gaussian message
is a struct of natural parameters, tau (precision times mean) and prec; a Wishart one of shape and rate,
with density proportional to |X| ** (shape - (d + 1) / 2) * exp(-trace(rate X)).  A Wishart belief
(``wishart``) has the inverse and log determinant of its rate too; as a column of its own it is
inverted once for all that read it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bound, digamma, gamma_ln


def dot(a: Column, b: Column) -> Column:
    """Of two vectors; of two symmetric matrices the trace of their product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def times(a: Column, factor: Column) -> Column:
    return F.transform(a, lambda x: x * factor)


def outer(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def applied(matrix: Column, vector: Column) -> Column:
    """Matrix times vector."""
    d = F.size(vector)
    return F.transform(vector, lambda _, r: dot(F.slice(matrix, r * d + 1, d), vector))


def swept(matrix: Column) -> Column:
    """Struct of the inverse and the log determinant of a positive definite matrix, by sweeping each pivot once."""

    def over(m: Column) -> Column:
        d = F.sqrt(F.size(m)).cast("int")

        def pivot(s: Column, k: Column) -> Column:
            p = F.get(s["a"], k * d + k)

            def entry(v: Column, i: Column) -> Column:
                r, c = F.floor(i / d).cast("int"), i % d
                other = v - F.get(s["a"], r * d + k) * F.get(s["a"], k * d + c) / p
                return F.when((r == k) & (c == k), F.lit(-1.0) / p).when((r == k) | (c == k), v / p).otherwise(other)

            return F.struct(F.transform(s["a"], entry).alias("a"), (s["log_det"] + F.log(p)).alias("log_det"))

        start = F.struct(m.alias("a"), F.lit(0.0).alias("log_det"))
        return F.aggregate(F.sequence(F.lit(0), d - 1), start, pivot, lambda s: F.struct(F.transform(s["a"], lambda v: -v).alias("inverse"), s["log_det"].alias("log_det")))

    return bound(matrix, over)


def natural(mean: Column, variance: Column) -> Column:
    return bound(swept(variance)["inverse"], lambda p: F.struct(applied(p, mean).alias("tau"), p.alias("prec")))


def moments(message: Column) -> Column:
    """Struct of mean and variance of a proper message."""
    return bound(swept(message["prec"])["inverse"], lambda v: F.struct(applied(v, message["tau"]).alias("mean"), v.alias("variance")))


def gaussian_to_either(mean: Column, variance: Column, noise: Column) -> Column:
    """To the sample from the mean, and the other way, under a known noise variance."""
    return natural(mean, plus(variance, noise))


def gaussian_variational(mean: Column, precision: Column) -> Column:
    """Variational message to the sample, or the mean, from the other's mean and the precision's belief."""
    return bound(wishart_mean(precision), lambda p: F.struct(applied(p, mean).alias("tau"), p.alias("prec")))


def precision_variational(x: Column, vx: Column, m: Column, vm: Column) -> Column:
    """Variational Wishart message to the precision."""
    spread = bound(minus(x, m), lambda gap: plus(plus(vx, vm), outer(gap, gap)))
    return F.struct(((F.size(x) + 2) / 2.0).alias("shape"), times(spread, F.lit(0.5)).alias("rate"))


def gaussian_log_average(x: Column, m: Column, variance: Column) -> Column:
    """ln N(x; m, variance)."""
    gap = minus(x, m)
    return bound(swept(variance), lambda s: (dot(gap, applied(s["inverse"], gap)) + s["log_det"] + F.size(x) * math.log(2 * math.pi)) * -0.5)


def gaussian_average_log(x: Column, vx: Column, m: Column, vm: Column, precision: Column) -> Column:
    """Mean log density under independent beliefs; the precision's is Wishart."""
    half = precision_variational(x, vx, m, vm)["rate"]
    return (wishart_mean_log_det(precision) - F.size(x) * math.log(2 * math.pi)) / 2.0 - dot(precision["inverse"], half) * precision["shape"]


def wishart(shape: Column, rate: Column) -> Column:
    """The belief of a shape and a rate."""
    return bound(swept(rate), lambda s: F.struct(shape.cast("double").alias("shape"), rate.alias("rate"), s["inverse"].alias("inverse"), s["log_det"].alias("log_det")))


def _over_dimensions(matrix: Column, term: Callable[[Column], Column]) -> Column:
    d = F.sqrt(F.size(matrix)).cast("int")
    return F.aggregate(F.sequence(F.lit(0), d - 1), F.lit(0.0), lambda s, i: s + term(i))


def wishart_mean(belief: Column) -> Column:
    return times(belief["inverse"], belief["shape"])


def wishart_mean_log_det(belief: Column) -> Column:
    return _over_dimensions(belief["rate"], lambda i: bound(belief["shape"] - i / 2.0, digamma)) - belief["log_det"]


def wishart_log_density(x: Column, belief: Column) -> Column:
    shape, rate = belief["shape"], belief["rate"]
    d = F.sqrt(F.size(rate))
    normaliser = _over_dimensions(rate, lambda i: bound(shape - i / 2.0, gamma_ln)) + d * (d - 1) * (math.log(math.pi) / 4)
    return (shape - (d + 1) / 2.0) * swept(x)["log_det"] - dot(rate, x) + shape * belief["log_det"] - normaliser


def wishart_from_scale(shape: Column, scale: Column) -> Column:
    return F.struct(shape.cast("double").alias("shape"), swept(scale)["inverse"].alias("rate"))


def wishart_product(a: Column, b: Column) -> Column:
    d = F.sqrt(F.size(a["rate"]))
    return F.struct((a["shape"] + b["shape"] - (d + 1) / 2.0).alias("shape"), plus(a["rate"], b["rate"]).alias("rate"))


def concatenated(m1: Column, v1: Column, m2: Column, v2: Column) -> Column:
    """Mean and variance of two independent vectors end to end."""

    def zeros(n: Column) -> Column:
        return F.array_repeat(F.lit(0.0), n)

    d1, d2 = F.size(m1), F.size(m2)
    upper = F.transform(m1, lambda _, r: F.concat(F.slice(v1, r * d1 + 1, d1), zeros(d2)))
    lower = F.transform(m2, lambda _, r: F.concat(zeros(d1), F.slice(v2, r * d2 + 1, d2)))
    return F.struct(F.concat(m1, m2).alias("mean"), F.flatten(F.concat(upper, lower)).alias("variance"))


def subvector(mean: Column, variance: Column, start: int, n: int) -> Column:
    """Mean and variance of n elements, from a place counted from 0."""
    d = F.size(mean)
    rows = [F.slice(variance, d * (start + k) + start + 1, n) for k in range(n)]
    return F.struct(F.slice(mean, start + 1, n).alias("mean"), F.concat(*rows).alias("variance"))


def added(messages: DataFrame, keys: list[str], *parameters: str) -> DataFrame:
    """Elementwise sums of array columns by key: the product of messages in natural parameters.

    Sums are pre-aggregated for each place of an array, so a hot key sends one row a task and place.
    """
    tagged = F.array(*[F.struct(F.lit(p).alias("p"), F.col(p).alias("values")) for p in parameters])
    flat = messages.select(*keys, F.explode(tagged).alias("t")).select(*keys, F.col("t.p").alias("p"), F.posexplode("t.values").alias("at", "v"))
    sums = flat.groupBy(*keys, "p", "at").agg(F.sum("v").alias("v"))
    lists = sums.groupBy(*keys).agg(*[F.sort_array(F.collect_list(F.when(F.col("p") == p, F.struct("at", "v")))).alias(p) for p in parameters])
    return lists.select(*keys, *[F.col(p)["v"].alias(p) for p in parameters])
