"""Distribution families in natural parameters.

Every family is stored so that uniform is zero, a product of messages is a sum, a ratio a difference
and a power a multiple.  A product over a group is then ``groupBy(...).agg(sum)`` of the columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import gamma_ln, logistic


@dataclass(frozen=True)
class Family:
    """Names of the natural parameters of a family."""

    name: str
    parameters: tuple[str, ...]

    def product(self, messages: DataFrame, *keys: str) -> DataFrame:
        """The product of all messages of each key."""
        return messages.groupBy(*keys).agg(*[F.sum(p).alias(p) for p in self.parameters])

    def cavity(self, messages: DataFrame, *keys: str) -> DataFrame:
        """To each message the product of the others of its key: marginal divided by itself.

        The marginals are pre-aggregated and joined back, so that a hot key isn't gathered.
        """
        marginals = messages.groupBy(*keys).agg(*[F.sum(p).alias(f"_{p}") for p in self.parameters])
        both = messages.join(marginals, list(keys))
        return both.select(*[(F.col(f"_{c}") - F.col(c)).alias(c) if c in self.parameters else F.col(c) for c in messages.columns])

    def power(self, messages: DataFrame, exponent: Column) -> DataFrame:
        return messages.withColumns({p: F.col(p) * exponent for p in self.parameters})

    def ratio(self, left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
        both = left.alias("l").join(right.alias("r"), list(keys))
        return both.select(*keys, *[(F.col(f"l.{p}") - F.col(f"r.{p}")).alias(p) for p in self.parameters])


GAUSSIAN = Family("gaussian", ("tau", "prec"))  # mean times precision, precision
BERNOULLI = Family("bernoulli", ("log_odds",))
BETA = Family("beta", ("a1", "b1"))  # true count - 1, false count - 1
GAMMA = Family("gamma", ("shape1", "rate"))  # shape - 1, rate
POISSON = Family("poisson", ("log_rate", "nu"))
DISCRETE = Family("discrete", ("logp",))  # a row for each value


def gaussian(mean: Column, variance: Column) -> tuple[Column, Column]:
    return mean / variance, F.lit(1.0) / variance


def gaussian_moments(tau: Column, prec: Column) -> tuple[Column, Column]:
    return tau / prec, F.lit(1.0) / prec


def gaussian_log_average_of(m1: Column, v1: Column, m2: Column, v2: Column) -> Column:
    """ln of the integral of a product of two Gaussians: ln N(m1; m2, v1 + v2)."""
    v = v1 + v2
    return -(F.log(v * (2 * math.pi)) + (m1 - m2) * (m1 - m2) / v) / 2.0


def bernoulli_probability(log_odds: Column) -> Column:
    return logistic(log_odds)


def beta_ln(a: Column, b: Column) -> Column:
    return gamma_ln(a) + gamma_ln(b) - gamma_ln(a + b)


def moment_matched(weight: Column, mean: Column, variance: Column) -> dict[str, Column]:
    """Aggregates: mean and variance of a weighted mixture (law of total variance)."""
    w = F.sum(weight)
    m = F.sum(weight * mean) / w
    return {"mean": m, "variance": F.sum(weight * (variance + mean * mean)) / w - m * m}
