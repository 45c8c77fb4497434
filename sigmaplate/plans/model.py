"""Declared models over plates of data, lowered to joins, projections and grouped sums.

A model names Gaussian variables over plates (key columns of the data), a noise variance and the sum
of which variables each observation is.  ``posteriors`` runs sweeps: each variable's posterior
is its prior times the grouped product of messages, a message being the observation less the other
variables' means, with their variances added to the noise.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialized


@dataclass
class Variable:
    name: str
    plate: str
    prior_mean: float
    prior_variance: float


@dataclass
class SumModel:
    """y = the sum of the variables at the row's keys + Gaussian noise."""

    y: str
    noise_variance: float
    variables: list[Variable] = field(default_factory=list)

    def gaussian(self, name: str, plate: str, mean: float = 0.0, variance: float = 1.0) -> SumModel:
        self.variables.append(Variable(name, plate, mean, variance))
        return self

    def posteriors(self, data: DataFrame, sweeps: int = 3) -> dict[str, DataFrame]:
        """Posterior (plate, mean, variance) of each variable.

        Variables are updated in their order, each from the latest means of the others; one shuffle
        of the data for each update.  A variable's belief is written as a table, as the next updates
        read it, so that a plan doesn't grow with the sweeps before it.
        """
        beliefs = {
            v.name: data.select(v.plate).distinct().select(v.plate, F.lit(v.prior_mean).alias("mean"), F.lit(v.prior_variance).alias("variance"))
            for v in self.variables
        }
        for _ in range(sweeps):
            for v in self.variables:
                rows, residual = data, F.col(self.y)
                for other in self.variables:
                    if other.name != v.name:
                        b = beliefs[other.name].select(other.plate, F.col("mean").alias(f"{other.name}_mean"))
                        rows, residual = rows.join(b, other.plate), residual - F.col(f"{other.name}_mean")
                s = rows.groupBy(v.plate).agg(F.count("*").alias("n"), F.sum(residual).alias("s"))
                prec = F.lit(1 / v.prior_variance) + F.col("n") / self.noise_variance
                mean = (F.lit(v.prior_mean / v.prior_variance) + F.col("s") / self.noise_variance) / prec
                beliefs[v.name] = s.select(v.plate, mean.alias("mean"), (F.lit(1.0) / prec).alias("variance"))
                beliefs[v.name] = materialized(beliefs[v.name])
        return beliefs
