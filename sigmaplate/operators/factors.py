"""Messages of closed-form factors as column expressions: truncation, comparison, maximum, logic, linear maps."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalar import bound, normal_cdf, normal_pdf
from ..functions.special import normal_cdf_ln, normal_cdf_ratio


def truncated_moments(mean: Column, variance: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Struct of the probability that a Gaussian lies between the bounds, its logarithm, and its mean and variance given that.

    None is no bound.  Bounds far in a tail are worked out relative to the density at the nearer
    one, so that mean and variance hold where the probability underflows.
    """
    sd = F.sqrt(variance)
    one, zero = F.lit(1.0), F.lit(0.0)

    def result(log_p: Column, shift: Column, spread: Column, sign: Column | None = None) -> Column:
        moved = sd * shift if sign is None else sd * shift * sign
        return F.struct(F.exp(log_p).alias("probability"), log_p.alias("log_probability"), (mean + moved).alias("mean"), (sd * sd * spread).alias("variance"))

    def half_line(a: Column, sign: float) -> Column:
        """Above a, in standard units."""
        slope = one / normal_cdf_ratio(-a)
        return bound(slope, lambda s: result(normal_cdf_ln(-a), s, one - s * (s - a), F.lit(sign)))

    def between(g: Column) -> Column:
        def tail(a: Column, b: Column, sign: float) -> Column:  # 0 < a < b
            e = F.exp((a - b) * (a + b) / 2.0)
            z = normal_cdf_ratio(-a) - e * normal_cdf_ratio(-b)
            log_p = F.log(z) - a * a / 2.0 - 0.5 * math.log(2 * math.pi)
            return bound(F.struct(z.alias("z"), e.alias("e")), lambda t: result(log_p, (one - t["e"]) / t["z"], one + (a - b * t["e"]) / t["z"] - F.pow((one - t["e"]) / t["z"], F.lit(2.0)), F.lit(sign)))

        def middle(a: Column, b: Column) -> Column:
            p = normal_cdf(b) - normal_cdf(a)
            pa, pb = normal_pdf(a), normal_pdf(b)
            return bound(F.struct(p.alias("p"), pa.alias("pa"), pb.alias("pb")), lambda t: result(
                F.log(t["p"]), (t["pa"] - t["pb"]) / t["p"], one + (a * t["pa"] - b * t["pb"]) / t["p"] - F.pow((t["pa"] - t["pb"]) / t["p"], F.lit(2.0)), one))

        return F.when(g["a"] > 0, tail(g["a"], g["b"], 1.0)).when(g["b"] < 0, tail(-g["b"], -g["a"], -1.0)).otherwise(middle(g["a"], g["b"]))

    if lower is None and upper is None:
        return F.struct(one.alias("probability"), zero.alias("log_probability"), mean.alias("mean"), variance.alias("variance"))
    if upper is None:
        return bound((F.lit(float(lower)) - mean) / sd, lambda a: half_line(a, 1.0))
    if lower is None:
        return bound((mean - float(upper)) / sd, lambda a: half_line(a, -1.0))
    return bound(F.struct(((F.lit(float(lower)) - mean) / sd).alias("a"), ((F.lit(float(upper)) - mean) / sd).alias("b")), between)


def greater_probability(m1: Column, v1: Column, m2: Column, v2: Column) -> Column:
    """Probability that the first of two independent Gaussians is the greater."""
    return bound((m1 - m2) / F.sqrt(v1 + v2), normal_cdf)


def maximum_moments(m1: Column, v1: Column, m2: Column, v2: Column) -> Column:
    """Struct of mean and variance of the greater of two independent Gaussians."""

    def weights(z: Column) -> Column:
        return F.struct(normal_cdf(z).alias("first"), normal_cdf(-z).alias("second"), normal_pdf(z).alias("density"))

    def moments(w: Column) -> Column:
        spread = F.sqrt(v1 + v2) * w["density"]
        mean = m1 * w["first"] + m2 * w["second"] + spread
        square = (m1 * m1 + v1) * w["first"] + (m2 * m2 + v2) * w["second"] + (m1 + m2) * spread
        return F.struct(mean.alias("mean"), (square - mean * mean).alias("variance"))

    return bound((m1 - m2) / F.sqrt(v1 + v2), lambda z: bound(weights(z), moments))


def linear_moments(terms: list[tuple[float, Column, Column]]) -> dict[str, Column]:
    """Moments of a weighted sum of independent variables, from (weight, mean, variance)."""
    return {
        "mean": sum((m * w for w, m, _ in terms), F.lit(0.0)),
        "variance": sum((v * (w * w) for w, _, v in terms), F.lit(0.0)),
    }


def all_of(*p: Column) -> Column:
    """Probability that independent conditions all hold."""
    out = F.lit(1.0)
    for q in p:
        out = out * q
    return out


def any_of(*p: Column) -> Column:
    return F.lit(1.0) - all_of(*[F.lit(1.0) - q for q in p])


def equal(p: Column, q: Column) -> Column:
    """Probability that two independent conditions agree."""
    return p * q + (F.lit(1.0) - p) * (F.lit(1.0) - q)


def all_of_message(result: Column, other: Column) -> Column:
    """Message to one condition of a conjunction: its probability under a uniform prior.

    result: the message from the conjunction; other: the probability of all other conditions.
    """
    no = F.lit(1.0) - result
    yes = result * other + no * (F.lit(1.0) - other)
    return yes / (yes + no)


def any_of_message(result: Column, other: Column) -> Column:
    return F.lit(1.0) - all_of_message(F.lit(1.0) - result, F.lit(1.0) - other)
