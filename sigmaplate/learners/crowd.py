"""Crowd labels: rater accuracy and true labels by alternating grouped sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def majority(votes: DataFrame) -> DataFrame:
    """votes: (task, worker, label 0/1).  The share of ones for each task."""
    return votes.groupBy("task").agg(F.avg("label").alias("p"))


def sweep(votes: DataFrame, belief: DataFrame, pseudo: float = 1.0) -> DataFrame:
    """New belief (task, p): rater accuracies under the old one, then a product of Bernoulli messages."""
    both = votes.join(belief, "task")
    agree = F.when(F.col("label") == 1, F.col("p")).otherwise(F.lit(1.0) - F.col("p"))
    skill = both.groupBy("worker").agg(((F.sum(agree) + pseudo) / (F.count("*") + 2 * pseudo)).alias("a"))
    log_odds = F.sum(F.when(F.col("label") == 1, F.log(F.col("a") / (F.lit(1.0) - F.col("a")))).otherwise(F.log((F.lit(1.0) - F.col("a")) / F.col("a"))))
    return votes.join(skill, "worker").groupBy("task").agg((F.lit(1.0) / (F.exp(-log_odds) + 1.0)).alias("p"))
