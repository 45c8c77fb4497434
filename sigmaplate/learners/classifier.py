"""Bayesian linear probit classifiers, trained by variational sweeps of mergeable sums.

Each row has a latent Gaussian score, the inner product of features and weights plus unit noise,
whose sign is the label.  Given the weights' mean, the mean of a row's score is in closed form;
given those, the weights are one Gaussian, of precision prior + X'X and mean from X' times the
scores.  X'X is summed once, X'scores and the bound on the evidence once a sweep: a task works through
its rows in Arrow batches and sends its sums, which are added up by cell, so that what comes back
grows with the number of features alone and no rows are gathered.

Several labels are taken one against the rest, with probabilities scaled to 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bound, normal_cdf

_CELLS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())])


@dataclass(frozen=True)
class Weights:
    """The posterior of a classifier's weights; the last one is the bias."""

    features: list[str]
    mean: np.ndarray
    covariance: np.ndarray
    evidence: tuple[float, ...] = ()
    moved: tuple[float, ...] = ()

    def as_rows(self) -> list[tuple[str, float, float]]:
        return [(n, float(m), float(v)) for n, m, v in zip([*self.features, "bias"], self.mean, np.diag(self.covariance), strict=True)]


def _log_cdf_and_ratio(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of the normal distribution function, and the density over it."""
    from numpy import exp, log, sqrt

    out = np.empty_like(t)
    low = t < -5
    near = t[~low]
    out[~low] = np.log(0.5 * np.array([math.erfc(-x / math.sqrt(2)) for x in near.tolist()]))
    x = -t[low]  # a continued fraction of the tail
    f = x.copy()
    for k in range(60, 0, -1):
        f = x + k / f
    out[low] = -x * x / 2 - log(sqrt(2 * math.pi) * f)
    return out, exp(-t * t / 2 - 0.5 * math.log(2 * math.pi) - out)


def _matrix(batch: pa.RecordBatch, n: int) -> np.ndarray:
    x = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(n)]
    return np.column_stack([*x, np.ones(batch.num_rows)])


def _cells(total: np.ndarray) -> pa.RecordBatch:
    i, j = np.indices(total.shape)
    return pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], schema=_CELLS)


def _summed(rows: DataFrame, run, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape)
    for r in rows.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def _prepared(data: DataFrame, features: list[str], positive: Column) -> DataFrame:
    return data.select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"f{k}") for k, f in enumerate(features)], F.when(positive, 1.0).otherwise(-1.0).alias("y"))


def fit(data: DataFrame, features: list[str], positive: Column, sweeps: int = 20, tolerance: float = 1e-6, prior: Weights | None = None, prior_variance: float = 1.0) -> Weights:
    """Weights for the rows where ``positive`` holds against the others; null features are 0.

    prior: the posterior of earlier data, for incremental training.  Ends after ``sweeps`` or once
    no weight's mean moves by more than ``tolerance``.
    """
    n, d = len(features), len(features) + 1
    rows = _prepared(data, features, positive)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = _matrix(batch, n)
            total += x.T @ x
        yield _cells(total)

    start = np.zeros(d) if prior is None else prior.mean
    precision = np.eye(d) / prior_variance if prior is None else np.linalg.inv(prior.covariance)
    posterior = precision + _summed(rows, products, (d, d))
    covariance = np.linalg.inv(posterior)
    mean, evidence, moved = start, [], []
    for _ in range(sweeps):
        now = mean

        def scores(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((1, d + 1))
            for batch in batches:
                x, y = _matrix(batch, n), batch.column(n).to_numpy(zero_copy_only=False)
                m = x @ now
                log_cdf, slope = _log_cdf_and_ratio(y * m)
                total[0, :d] += x.T @ (m + y * slope)
                total[0, d] += log_cdf.sum()
            yield _cells(total)

        sums = _summed(rows, scores, (1, d + 1))[0]
        away = now - start
        evidence.append(float(sums[d] - away @ precision @ away / 2 + (np.linalg.slogdet(precision)[1] - np.linalg.slogdet(posterior)[1]) / 2))
        mean = covariance @ (precision @ start + sums[:d])
        moved.append(float(np.abs(mean - now).max()))
        if moved[-1] < tolerance:
            break
    return Weights(list(features), mean, covariance, tuple(evidence), tuple(moved))


def score(weights: Weights) -> Column:
    """Probability of the positive label: the normal distribution function of mean over deviation of the noisy score."""
    x = [*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in weights.features], F.lit(1.0)]
    mean = sum((c * float(m) for c, m in zip(x, weights.mean, strict=True)), F.lit(0.0))
    variance = F.lit(1.0)
    for i, a in enumerate(x):
        for j in range(i, len(x)):
            variance = variance + a * x[j] * float(weights.covariance[i, j] * (1 if i == j else 2))
    return bound(mean / F.sqrt(variance), normal_cdf)


def train(data: DataFrame, features: list[str], label: str, sweeps: int = 20, **options) -> Weights:
    """A binary classifier of a label of 0 and 1, or false and true."""
    return fit(data, features, F.col(label).cast("int") == 1, sweeps, **options)


def predict(data: DataFrame, weights: Weights) -> DataFrame:
    """data with p, the probability of the positive label."""
    return data.withColumn("p", score(weights))


def train_multiclass(data: DataFrame, features: list[str], label: str, labels: list, sweeps: int = 20, prior: dict | None = None) -> dict:
    """A classifier for each of the labels against the rest."""
    return {v: fit(data, features, F.col(label) == F.lit(v), sweeps, prior=None if prior is None else prior[v]) for v in labels}


def predict_multiclass(data: DataFrame, models: dict) -> DataFrame:
    """data with p, a map of the labels' probabilities, and predicted, the likeliest (ties to the first)."""
    labels = list(models)
    raw = F.array(*[score(models[v]) for v in labels])
    each = data.withColumn("_raw", raw)
    share = F.transform("_raw", lambda x: x / F.aggregate("_raw", F.lit(0.0), lambda s, v: s + v))
    names = F.array(*[F.lit(v) for v in labels])
    best = F.element_at(names, F.array_position("_raw", F.array_max("_raw")).cast("int"))
    return each.withColumns({"p": F.map_from_arrays(names, share), "predicted": best}).drop("_raw")


def sample_weights(weights: Weights, n: int, seed: int = 0) -> np.ndarray:
    """n draws of the weights from their posterior."""
    return np.random.default_rng(seed).multivariate_normal(weights.mean, weights.covariance, n)


def _rank(data: DataFrame, column: str) -> Column:
    """A number that grows with the column; of a text its first 7 bytes, so that texts that share them share a range."""
    if dict(data.dtypes)[column] != "string":
        return F.col(column)
    return F.conv(F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")


def numbered(data: DataFrame, order: list[str], number: str = "number", ranges: int = 256) -> DataFrame:
    """data with row numbers from 0 in an order (the last column tells rows apart): ranks within value ranges of the first column, offset by the ranges' counts."""
    rank = _rank(data, order[0])
    bounds = data.agg(F.percentile_approx(rank, [k / ranges for k in range(1, ranges)], 1000).alias("_bounds"))
    ranked = data.withColumn("_rank", rank)
    at = F.coalesce(F.size(F.filter("_bounds", lambda b: b <= F.col("_rank"))), F.lit(-1))
    each = ranked.join(F.broadcast(bounds)).withColumn("_range", F.when(F.col("_rank").isNull(), -1).otherwise(at)).drop("_bounds", "_rank")  # one row
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = each.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return each.withColumn("_place", place).join(F.broadcast(starts), "_range").withColumn(number, F.col("_base") + F.col("_place")).drop("_range", "_place", "_base")


def cross_validation_folds(data: DataFrame, row: str, folds: int) -> DataFrame:
    """data with fold: contiguous by row number in the order of ``row``; the last takes the rest."""
    n = data.count()
    return numbered(data, [row], "_number").withColumn("fold", F.least(F.floor(F.col("_number") / max(1, n // folds)), F.lit(folds - 1)).cast("int")).drop("_number")


def cross_validate(data: DataFrame, features: list[str], label: str, row: str, folds: int, sweeps: int = 20) -> DataFrame:
    """(fold, n, accuracy, negative_log_probability) of binary classifiers trained on the other folds."""
    dealt = cross_validation_folds(data, row, folds).persist()
    out = None
    for k in range(folds):
        weights = train(dealt.where(F.col("fold") != k), features, label, sweeps)
        p, yes = F.col("p"), F.col(label).cast("int") == 1
        right = F.when(yes, p).otherwise(F.lit(1.0) - p)
        part = predict(dealt.where(F.col("fold") == k), weights).groupBy("fold").agg(
            F.count("*").alias("n"), F.avg((right > 0.5).cast("double")).alias("accuracy"), F.avg(-F.log(right)).alias("negative_log_probability")
        )
        out = part if out is None else out.unionByName(part)
    return out
