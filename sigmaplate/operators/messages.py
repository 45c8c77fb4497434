"""Message passing as dataflow: replication, gates, chains, lookups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import index_of_maximum, softmax


def gather(values: DataFrame, index: DataFrame, on: str) -> DataFrame:
    """array[index]: each row of index with its value; Spark picks the join's form by size."""
    return index.join(values, on)


def _scores(x: Column, components: list[tuple[float, float, float]]) -> Column:
    """The array of each component's log weight times its density at x, but for a constant."""
    return F.array(*[F.lit(math.log(w) - math.log(v) / 2) - (x - float(m)) * (x - float(m)) / (2.0 * v) for w, m, v in components])


def mixture_gate(data: DataFrame, row: str, x: Column, components: list[tuple[float, float, float]]) -> DataFrame:
    """A gate with a random condition: the posterior of the case for each row, worked out inside the row.

    components: (weight, mean, variance) of Gaussian cases.
    """
    each = data.select(row, x.alias("x"), F.posexplode(softmax(_scores(x, components))).alias("component", "responsibility"))
    return each.select(row, "x", "component", "responsibility")


def best_component(data: DataFrame, row: str, x: Column, components: list[tuple[float, float, float]]) -> DataFrame:
    """The case of the highest score for each row, ties to the first."""
    scores = data.select(row, _scores(x, components).alias("s"))
    return scores.select(row, index_of_maximum(F.col("s")).cast("int").alias("component"), F.array_max("s").alias("score"))


def forward(data: DataFrame, series: str, order: list[str], likelihood: list[Column], transition: list[list[float]], prior: list[float]) -> DataFrame:
    """Filtered state probabilities of a discrete Markov chain per series.

    likelihood: a column for each state.  A series is folded in order, step by step, inside the
    JVM; its observations are gathered, so a series must fit a task, as its chain is sequential.
    """
    k = len(prior)
    step = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.array(*likelihood).alias("l"))
    chains = data.groupBy(series).agg(F.sort_array(F.collect_list(step)).alias("steps"))
    t = [[F.lit(float(v)) for v in r] for r in transition]

    def advance(state: Column, s: Column) -> Column:
        ahead = [sum((state["p"][i] * t[i][j] for i in range(1, k)), state["p"][0] * t[0][j]) for j in range(k)]
        raw = [F.when(state["first"], F.lit(float(prior[j]))).otherwise(ahead[j]) * s["l"][j] for j in range(k)]
        total = sum(raw[1:], raw[0])
        return F.struct(
            F.lit(False).alias("first"),
            F.transform(F.array(*raw), lambda v: v / total).alias("p"),
            (state["evidence"] + F.log(total)).alias("evidence"),
        )

    start = F.struct(F.lit(True).alias("first"), F.array(*[F.lit(float(p)) for p in prior]).alias("p"), F.lit(0.0).alias("evidence"))
    end = chains.select(series, F.size("steps").cast("long").alias("n"), F.aggregate("steps", start, advance).alias("end"))
    return end.select(series, "n", F.col("end.p").alias("p"), F.col("end.evidence").alias("log_evidence"))


def conditional_table(data: DataFrame, parents: list[str], child: str, pseudo: float, cardinality: int) -> DataFrame:
    """A conditional probability table with pseudo-counts, for the pairs that occur."""
    counts = data.groupBy(*parents, child).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*parents))
    return counts.select(*parents, child, ((F.col("n") + pseudo) / (total + pseudo * cardinality)).alias("p"))


def max_sum(scores: DataFrame, row: str, value: str, score: Column) -> DataFrame:
    """The best value of each row, ties by the least value."""
    best = scores.groupBy(row).agg(F.max(F.struct(score.alias("s"), (-F.col(value)).alias("v"))).alias("best"))
    return best.select(row, (-F.col("best.v")).alias(value), F.col("best.s").alias("score"))
