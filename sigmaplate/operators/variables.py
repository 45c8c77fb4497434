"""Nodes of variables: marginals, points, maxima, Gibbs chains, and edges that cut or change the power of messages.

Gaussian messages are structs of natural parameters tau and prec, as in ``factor_messages``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalar import bound
from .factor_messages import powered


def uniform() -> Column:
    return F.struct(F.lit(0.0).alias("tau"), F.lit(0.0).alias("prec"))


def product(a: Column, b: Column) -> Column:
    return F.struct(*[(a[p] + b[p]).alias(p) for p in ("tau", "prec")])


def variable(definition: Column, use: Column, variational: bool = False, derived: bool = False) -> Column:
    """Struct of marginal, to_use and to_definition of a variable's node.

    In expectation propagation the use hears the definition and the definition the use.  Variationally
    the use hears the marginal, which is the definition alone for a derived variable.
    """
    marginal = definition if variational and derived else product(definition, use)
    return F.struct(marginal.alias("marginal"), (marginal if variational else definition).alias("to_use"), use.alias("to_definition"))


def initialised(message: Column, init: Column) -> Column:
    """The given message until the schedule has computed one."""
    return F.coalesce(message, init)


def max_marginal(definition: Column, use: Column) -> Column:
    """Log scores of a discrete variable's values for max-product, 0 for the best."""
    both = F.zip_with(definition, use, lambda x, y: x + y)
    return bound(both, lambda b: F.transform(b, lambda x: x - F.array_max(b)))


def gaussian_point(definition: Column, use: Column) -> Column:
    """The point at the mode of the product."""
    return bound(product(definition, use), lambda m: m["tau"] / m["prec"])


def gamma_point(shape: Column, rate: Column) -> Column:
    return F.greatest(shape - 1.0, F.lit(0.0)) / rate


def beta_point(a: Column, b: Column) -> Column:
    """Inside for counts over 1; else at the end with the larger count, or the middle for equal ones."""
    inside = (a - 1.0) / (a + b - 2.0)
    return F.when((a > 1) & (b > 1), inside).when(a == b, 0.5).otherwise((a > b).cast("double"))


def rprop(start: Column, derivative: Callable[[Column], Column], size: float = 0.1, steps: int = 100) -> Column:
    """The place near start where a log density is highest, by resilient steps on its derivative's sign.

    A step is 1.2 times the last one while the sign stays and half of it when it turns.
    """

    def step(s: Column, _: Column) -> Column:
        def moved(g: Column) -> Column:
            grown = F.when(g * s["sign"] > 0, s["size"] * 1.2).when(g * s["sign"] < 0, s["size"] * 0.5).otherwise(s["size"])
            return bound(grown, lambda n: F.struct((s["x"] + g * n).alias("x"), n.alias("size"), g.alias("sign")))

        return bound(F.signum(derivative(s["x"])), moved)

    first = F.struct(start.cast("double").alias("x"), F.lit(size).alias("size"), F.lit(0.0).alias("sign"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, step, lambda s: s["x"])


# Edges


def cut_back() -> Column:
    """What a cut sends back: nothing."""
    return uniform()


def forward_when(message: Column, cut: Column) -> Column:
    """The message unless the flag cuts it; a null flag doesn't."""
    return F.when(F.coalesce(cut, F.lit(False)), uniform()).otherwise(message)


def shift_power(variable_message: Column, factor_message: Column, variable_alpha: float, factor_alpha: float) -> Column:
    """Between a variable and a factor of different powers of the divergence."""
    return product(variable_message, powered(factor_message, F.lit(variable_alpha - factor_alpha)))


# Gibbs sampling


def gibbs(start: Column, step: Callable[[Column, Column], Column], burn_in: int, thin: int, samples: int) -> Column:
    """Array of every thin-th state of a chain after burn_in sweeps.

    step: the next state (a struct as start is) from the state and the sweep's number, from 1, which its
    draws must be keyed by for a rerun to give the same.  A chain is one row's expression.
    """

    def sweep(s: Column, t: Column) -> Column:
        keep = (t > burn_in) & ((t - burn_in) % thin == 0)
        return bound(step(s["state"], t), lambda x: F.struct(x.alias("state"), F.when(keep, F.concat(s["kept"], F.array(x))).otherwise(s["kept"]).alias("kept")))

    first = F.struct(start.alias("state"), F.slice(F.array(start), 1, 0).alias("kept"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(burn_in + thin * samples)), first, sweep, lambda s: s["kept"])


def mixed_conditionals(kept: Column, mean: str, variance: str) -> Column:
    """Mean and variance of the equal mixture of the kept states' conditionals."""

    def total(f: Callable[[Column], Column]) -> Column:
        return F.aggregate(kept, F.lit(0.0), lambda s, x: s + f(x)) / F.size(kept)

    centre = total(lambda x: x[mean])
    square = total(lambda x: x[variance] + x[mean] * x[mean])
    return F.struct(centre.alias("mean"), (square - centre * centre).alias("variance"))
