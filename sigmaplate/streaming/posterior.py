"""Incremental posteriors: a stream's state is the sum of natural parameters for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def statistics(events: DataFrame, key: str, x: str) -> DataFrame:
    """Running sufficient statistics of x for each key; batch or stream (update or complete mode)."""
    return events.groupBy(key).agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(F.col(x) * F.col(x)).alias("q"))


def posterior(stats: DataFrame, key: str, prior_mean: float, prior_variance: float, noise_variance: float) -> DataFrame:
    prec = F.lit(1.0 / prior_variance) + F.col("n") / noise_variance
    return stats.select(key, "n", ((F.lit(prior_mean / prior_variance) + F.col("s") / noise_variance) / prec).alias("mean"), (F.lit(1.0) / prec).alias("variance"))


def windowed_rate(events: DataFrame, ts: str, key: str, width: str, late: str, shape: float = 1.0, rate: float = 1.0) -> DataFrame:
    """Posterior mean of a Poisson rate for each tumbling window and key, with late rows up to ``late``."""
    timed = events.withColumn("at", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("at", late) if events.isStreaming else timed
    n = timed.groupBy(F.window("at", width).alias("w"), key).agg(F.count("*").alias("n"))
    return n.select(F.col("w.start").alias("start"), key, "n", ((F.col("n") + shape) / (1.0 + rate)).alias("rate"))
