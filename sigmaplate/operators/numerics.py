"""Kernels, intervals, sparse and piecewise vectors, small dense matrices, quadrature and search."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kernels: functions of two arrays of inputs


def _squares(a: Column, b: Column, scale: Column | None = None) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    if scale is not None:
        gaps = F.zip_with(gaps, scale, lambda g, s: g / (s * s))
    return F.aggregate(gaps, F.lit(0.0), lambda t, v: t + v)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)


def squared_exponential(log_length: float, log_scale: float = 0.0) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.exp(F.lit(2 * log_scale) - _squares(a, b) / (2 * math.exp(2 * log_length)))


def ard(log_lengths: list[float], log_scale: float = 0.0) -> Callable[[Column, Column], Column]:
    """A squared exponential with a length for each dimension."""
    scale = lambda: F.array(*[F.lit(math.exp(v)) for v in log_lengths])
    return lambda a, b: F.exp(F.lit(2 * log_scale) - _squares(a, b, scale()) / 2.0)


def linear_kernel(log_weight_variances: list[float], log_bias_variance: float) -> Callable[[Column, Column], Column]:
    def value(a: Column, b: Column) -> Column:
        weights = F.array(*[F.lit(math.exp(v)) for v in log_weight_variances])
        return F.lit(math.exp(log_bias_variance)) + _dot(F.zip_with(a, weights, lambda x, w: x * w), b)

    return value


def neural_kernel(log_weight_variances: list[float], log_bias_variance: float) -> Callable[[Column, Column], Column]:
    """That of a layer of infinitely many sigmoid units: an arc sine of normalised inner products."""
    inner = linear_kernel(log_weight_variances, log_bias_variance)

    def value(a: Column, b: Column) -> Column:
        return F.asin(inner(a, b) * 2.0 / F.sqrt((inner(a, a) * 2.0 + 1.0) * (inner(b, b) * 2.0 + 1.0))) * (2 / math.pi)

    return value


def white_noise(log_deviation: float) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.when(a == b, math.exp(2 * log_deviation)).otherwise(0.0)


def summed(*kernels: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: sum((k(a, b) for k in kernels), F.lit(0.0))


#: Kernels by name, for models that are stored as text.
KERNELS: dict[str, Callable] = {
    "squared_exponential": squared_exponential, "ard": ard, "linear": linear_kernel, "neural": neural_kernel, "white_noise": white_noise, "sum": summed,
}


def kernel(name: str, *parameters) -> Callable[[Column, Column], Column]:
    return KERNELS[name](*parameters)


# Intervals: structs of lo and hi


def interval(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))


def interval_sum(a: Column, b: Column) -> Column:
    return interval(a["lo"] + b["lo"], a["hi"] + b["hi"])


def interval_difference(a: Column, b: Column) -> Column:
    return interval(a["lo"] - b["hi"], a["hi"] - b["lo"])


def interval_product(a: Column, b: Column) -> Column:
    ends = [a[x] * b[y] for x in ("lo", "hi") for y in ("lo", "hi")]
    return interval(F.least(*ends), F.greatest(*ends))


def interval_square(a: Column) -> Column:
    lo, hi = a["lo"] * a["lo"], a["hi"] * a["hi"]
    return interval(F.when((a["lo"] <= 0) & (a["hi"] >= 0), 0.0).otherwise(F.least(lo, hi)), F.greatest(lo, hi))


def interval_map(a: Column, rising: Callable[[Column], Column]) -> Column:
    """The image under a rising function, such as exp or the normal distribution function."""
    return interval(rising(a["lo"]), rising(a["hi"]))


def interval_union(a: Column, b: Column) -> Column:
    return interval(F.least(a["lo"], b["lo"]), F.greatest(a["hi"], b["hi"]))


def region_log_volume(region: Column) -> Column:
    """ln of the volume of an array of intervals."""
    return F.aggregate(region, F.lit(0.0), lambda t, a: t + F.log(a["hi"] - a["lo"]))


def region_midpoint(region: Column) -> Column:
    return F.transform(region, lambda a: (a["lo"] + a["hi"]) / 2.0)


def region_contains(region: Column, point: Column) -> Column:
    return F.forall(F.zip_with(region, point, lambda a, x: (a["lo"] <= x) & (x <= a["hi"])), lambda v: v)


# Numbers mantissa * exp(exponent), beyond the range of doubles


def extended_product(a: Column, b: Column) -> Column:
    return F.struct((a["mantissa"] * b["mantissa"]).alias("mantissa"), (a["exponent"] + b["exponent"]).alias("exponent"))


def extended_sum(a: Column, b: Column) -> Column:
    top = F.greatest(a["exponent"], b["exponent"])
    return F.struct((a["mantissa"] * F.exp(a["exponent"] - top) + b["mantissa"] * F.exp(b["exponent"] - top)).alias("mantissa"), top.alias("exponent"))


def extended_log(a: Column) -> Column:
    return F.log(a["mantissa"]) + a["exponent"]


# Sparse vectors (row, i, v) with a common value, and piecewise ones (row, lo, hi, v)


def sparse_dot(a: DataFrame, b: DataFrame, row: str, common_a: float, common_b: float, size: int) -> DataFrame:
    """(row, dot): inner products of sparse vectors whose other elements have a common value."""
    both = a.select(row, "i", F.col("v").alias("x")).join(b.select(row, "i", F.col("v").alias("y")), [row, "i"], "full")
    x, y = F.coalesce("x", F.lit(common_a)), F.coalesce("y", F.lit(common_b))
    s = both.groupBy(row).agg(F.sum(x * y).alias("s"), F.count("*").alias("n"))
    return s.select(row, (F.col("s") + (F.lit(size) - F.col("n")) * (common_a * common_b)).alias("dot"))


def sparse_sums(a: DataFrame, row: str, common: float, size: int) -> DataFrame:
    """(row, sum, max): over all elements, listed and common."""
    s = a.groupBy(row).agg(F.sum("v").alias("s"), F.count("*").alias("n"), F.max("v").alias("m"))
    rest = F.lit(size) - F.col("n")
    return s.select(row, (F.col("s") + rest * common).alias("sum"), F.when(rest > 0, F.greatest("m", F.lit(common))).otherwise(F.col("m")).alias("max"))


def piecewise_at(pieces: DataFrame, points: DataFrame, row: str, at: str, common: float) -> DataFrame:
    """points (row, at) with the value of the piece that holds them, or the common value; pieces don't overlap."""
    p, q = pieces.alias("p"), points.alias("q")
    inside = (F.col(f"p.{row}") == F.col(f"q.{row}")) & (F.col(f"q.{at}") >= F.col("p.lo")) & (F.col(f"q.{at}") <= F.col("p.hi"))
    return q.join(p, inside, "left").select(*[F.col(f"q.{c}") for c in points.columns], F.coalesce("p.v", F.lit(common)).alias("v"))


# Small dense matrices, one a key


def matrix_figures(rows: DataFrame, key: str, matrix: str, vector: str) -> DataFrame:
    """(key, log_det, trace_inverse, largest, solved): of symmetric positive matrices, flat arrays of n * n, and right sides of n.

    By Cholesky factors; null where a matrix isn't positive definite.
    """
    kind = dict(rows.dtypes)[key]

    def run(frames):
        for frame in frames:
            out = []
            for k, m, b in zip(frame[key], frame[matrix], frame[vector], strict=True):
                b = np.asarray(b, float)
                a = np.asarray(m, float).reshape(len(b), len(b))
                try:
                    low = np.linalg.cholesky(a)
                except np.linalg.LinAlgError:
                    out.append((k, None, None, None, None))
                    continue
                inverse = np.linalg.solve(low, np.eye(len(b)))
                out.append((k, float(2 * np.log(np.diag(low)).sum()), float((inverse**2).sum()), float(np.linalg.eigvalsh(a)[-1]), (inverse.T @ (inverse @ b)).tolist()))
            yield pd.DataFrame(out, columns=[key, "log_det", "trace_inverse", "largest", "solved"])

    return rows.select(key, matrix, vector).mapInPandas(run, f"`{key}` {kind}, log_det double, trace_inverse double, largest double, solved array<double>")


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row order, unit lower and upper factors of a square matrix, with partial pivoting."""
    u, order = np.array(a, float), np.arange(len(a))
    for k in range(len(u)):
        p = k + int(np.argmax(np.abs(u[k:, k])))
        u[[k, p]], order[[k, p]] = u[[p, k]], order[[p, k]]
        if u[k, k]:
            u[k + 1 :, k] /= u[k, k]
            u[k + 1 :, k + 1 :] -= np.outer(u[k + 1 :, k], u[k, k + 1 :])
    return order, np.tril(u, -1) + np.eye(len(u)), np.triu(u)


# Quadrature and continued fractions


def laguerre(f: Callable[[Column], Column], n: int = 32) -> Column:
    """Integral over t > 0 of exp(-t) f(t)."""
    from ..functions.special import _nodes

    points, weights = np.polynomial.laguerre.laggauss(n)
    return _nodes(points.tolist(), weights.tolist(), f)


def clenshaw_curtis(f: Callable[[np.ndarray], np.ndarray], tolerance: float = 1e-10, most: int = 1 << 14) -> float:
    """Integral over the real line by the trapezoid rule behind t = cot(theta), points doubled until it settles."""
    n, last = 8, math.inf
    while n <= most:
        theta = (np.arange(n) + 0.5) * math.pi / n
        got = float((f(1 / np.tan(theta)) / np.sin(theta) ** 2).sum() * math.pi / n)
        if abs(got - last) <= tolerance * max(1.0, abs(got)):
            return got
        n, last = 2 * n, got
    return last


def continued_fraction(numerator: Callable[[Column], Column], denominator: Callable[[Column], Column], terms: int) -> Column:
    """b0 + a1 / (b1 + a2 / (b2 + ...)), from the last term back; functions of the term's number."""
    return F.aggregate(F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), denominator(F.lit(terms + 1)), lambda f, k: denominator(k - 1) + numerator(k) / f)


# Search on the driver; the function may run a query for a value and its slope


def line_search(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, direction: np.ndarray, c1: float = 1e-4, c2: float = 0.9) -> tuple[np.ndarray, float, np.ndarray]:
    """A step along a direction that satisfies Wolfe's conditions, by bisection and doubling."""
    start, slope = f(x)
    along, low, high, step = float(slope @ direction), 0.0, math.inf, 1.0
    for _ in range(50):
        at = x + step * direction
        value, grad = f(at)
        if value > start + c1 * step * along:
            high = step
        elif grad @ direction < c2 * along:
            low = step
        else:
            break
        step = (low + high) / 2 if high < math.inf else 2 * step
    return at, value, grad


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, memory: int = 8, steps: int = 100, tolerance: float = 1e-8) -> np.ndarray:
    """The least value of a smooth function, from its value and slope, with the last ``memory`` steps; all of them give BFGS."""
    value, grad = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(grad).max() < tolerance:
            break
        q, alphas = grad.copy(), []
        for s, y in reversed(past):
            alphas.append(float(s @ q) / float(s @ y))
            q -= alphas[-1] * y
        if past:
            s, y = past[-1]
            q *= float(s @ y) / float(y @ y)
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            q += s * (a - float(y @ q) / float(s @ y))
        new, value, slope = line_search(f, x, -q)
        s, y = new - x, slope - grad
        if float(s @ y) > 1e-14:
            past = [*past, (s, y)][-memory:]
        x, grad = new, slope
    return x


def branch_and_bound(f: Callable[[list[tuple[float, float]]], float], region: list[tuple[float, float]], tolerance: float = 1e-3) -> list[float]:
    """The point of a box with the largest value, given an upper bound over boxes that tightens as they shrink."""
    heap = [(-f(region), 0, region)]
    count = 0
    while True:
        _, _, box = heapq.heappop(heap)
        width, k = max((hi - lo, i) for i, (lo, hi) in enumerate(box))
        if width <= tolerance:
            return [(lo + hi) / 2 for lo, hi in box]
        lo, hi = box[k]
        for half in ((lo, (lo + hi) / 2), ((lo + hi) / 2, hi)):
            count += 1
            part = [*box[:k], half, *box[k + 1 :]]
            heapq.heappush(heap, (-f(part), count, part))


def logistic_objective(data: DataFrame, features: list[str], label: str, penalty: float = 1.0) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Loss and slope of a logistic regression as one aggregation over the data; for ``lbfgs``."""

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = sum((F.col(f) * float(v) for f, v in zip(features, w, strict=True)), F.lit(0.0))
        y = F.col(label).cast("double")
        p = F.lit(1.0) / (F.exp(-z) + 1.0)
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z
        got = data.agg(F.sum(loss), *[F.sum((p - y) * F.col(f)) for f in features]).first()
        return float(got[0]) + penalty * float(w @ w) / 2, np.array(got[1:], float) + penalty * w

    return value
