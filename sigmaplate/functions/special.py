"""More special functions as column expressions: gamma and normal families, logistic-Gaussian integrals, arrays, floating point."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import pairs
from .scalar import bound, digamma, erfc, erfcx, gamma_ln, log1m_exp, log1p_exp, logistic, normal_cdf, normal_cdf_inverse, normal_pdf, rising_factorial_ln

_ROOT2 = math.sqrt(2.0)


def _nodes(points: list[float], weights: list[float], f) -> Column:
    """Sum of weight * f(point) over a fixed rule."""
    rule = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(w)).alias("w")) for x, w in zip(points, weights, strict=True)])
    return F.aggregate(rule, F.lit(0.0), lambda s, n: s + n["w"] * f(n["x"]))


def over_interval(f, lower: Column, upper: Column, n: int = 32) -> Column:
    """Gauss-Legendre integral of f from lower to upper."""
    points, weights = np.polynomial.legendre.leggauss(n)
    half, middle = (upper - lower) / 2.0, (upper + lower) / 2.0
    return half * _nodes(points.tolist(), weights.tolist(), lambda x: f(middle + half * x))


def gaussian_mean_of(f, mean: Column, variance: Column, n: int = 48) -> Column:
    """Gauss-Hermite expectation of f under a Gaussian."""
    points, weights = np.polynomial.hermite.hermgauss(n)
    scale = F.sqrt(variance * 2.0)
    return _nodes(points.tolist(), (weights / math.sqrt(math.pi)).tolist(), lambda x: f(mean + scale * x))


# Gamma family


def gamma(x: Column) -> Column:
    """Gamma function, by reflection below one half; null at the poles."""
    pole = (x <= 0) & (x == F.floor(x))
    low = F.lit(math.pi) / (F.sin(x * math.pi) * F.exp(gamma_ln(F.lit(1.0) - x)))
    return F.when(pole, None).when(x < 0.5, low).otherwise(F.exp(gamma_ln(x)))


def beta(a: Column, b: Column) -> Column:
    return F.exp(gamma_ln(a) + gamma_ln(b) - gamma_ln(a + b))


def tetragamma(x: Column) -> Column:
    """Third derivative of gamma_ln: argument shifted by 8, then the asymptotic series."""
    shifted = F.lit(0.0)
    for k in range(8):
        y = x + float(k)
        shifted = shifted + F.lit(2.0) / (y * y * y)
    z = x + 8.0
    series = F.lit(0.0)
    for k, b in enumerate((1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66), 1):  # Bernoulli numbers B2..B10
        series = series + F.lit(b * (2 * k + 1)) / F.pow(z, F.lit(2.0 * k + 2))
    return -(F.lit(1.0) / (z * z) + F.lit(1.0) / (z * z * z) + series + shifted)


def rising_factorial_ln_over_n(x: Column, n: Column) -> Column:
    """rising_factorial_ln(x, n) / n; its limit digamma(x) for n = 0."""
    return F.when(n == 0, digamma(x)).otherwise(rising_factorial_ln(x, n) / n)


def reciprocal_factorial_minus1(x: Column) -> Column:
    """1 / gamma(1 + x) - 1."""
    return F.expm1(-gamma_ln(x + 1.0))


def bessel_i(order: Column, x: Column, terms: int = 60) -> Column:
    """Modified Bessel function of the first kind, for x >= 0, by its power series."""
    first = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def add(s: Column, k: Column) -> Column:
        t = s["t"] * x * x / 4.0 / (k * (k + order))
        return F.struct(t.alias("t"), (s["s"] + t).alias("s"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), first, add, lambda s: s["s"])
    return F.when(x == 0, F.when(order == 0, 1.0).otherwise(0.0)).otherwise(F.exp(order * F.log(x / 2.0) - gamma_ln(order + 1.0)) * total)


def gamma_upper_log_scale(a: Column, x: Column) -> Column:
    """ln of x**a exp(-x) / gamma(a)."""
    return a * F.log(x) - x - gamma_ln(a)


def gamma_upper_scale(a: Column, x: Column) -> Column:
    return F.exp(gamma_upper_log_scale(a, x))


def _lower_series(a: Column, x: Column, terms: int = 120) -> Column:
    """The regularised lower incomplete gamma function over its scale, for x < a + 1."""
    first = F.struct((F.lit(1.0) / a).alias("t"), (F.lit(1.0) / a).alias("s"))

    def add(s: Column, k: Column) -> Column:
        t = s["t"] * x / (a + k)
        return F.struct(t.alias("t"), (s["s"] + t).alias("s"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), first, add, lambda s: s["s"])


def _upper_fraction(a: Column, x: Column, terms: int = 120) -> Column:
    """The upper one over its scale, for x >= a + 1: a continued fraction from its end."""
    return F.lit(1.0) / F.aggregate(
        F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), x + 1.0 - a + 2.0 * (terms + 1),
        lambda f, k: x + 2.0 * k - 1.0 - a + k.cast("double") * (a - k) / f,
    )


def gamma_lower(a: Column, x: Column) -> Column:
    """Regularised lower incomplete gamma function, for a > 0 and x >= 0."""
    low = gamma_upper_scale(a, x) * _lower_series(a, x)
    return F.when(x == 0, 0.0).when(x < a + 1.0, low).otherwise(F.lit(1.0) - gamma_upper_scale(a, x) * _upper_fraction(a, x))


def gamma_upper(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function."""
    low = gamma_upper_scale(a, x) * _lower_series(a, x)
    return F.when(x == 0, 1.0).when(x < a + 1.0, F.lit(1.0) - low).otherwise(gamma_upper_scale(a, x) * _upper_fraction(a, x))


def log_gamma_upper(a: Column, x: Column) -> Column:
    """ln of the unregularised upper incomplete gamma function; keeps its digits in the far tail."""
    far = a * F.log(x) - x + F.log(_upper_fraction(a, x))
    return F.when(x >= a + 1.0, far).otherwise(F.log(gamma_upper(a, x)) + gamma_ln(a))


def gamma_prob_between(shape: Column, rate: Column, lower: Column, upper: Column) -> Column:
    """Probability that a gamma variable lies between the bounds."""
    above = gamma_upper(shape, rate * lower) - gamma_upper(shape, rate * upper)
    below = gamma_lower(shape, rate * upper) - gamma_lower(shape, rate * lower)
    return F.when(rate * lower > shape, above).otherwise(below)


def beta_prob_less(a: Column, b: Column, x: Column, n: int = 96) -> Column:
    """Regularised incomplete beta function, for a, b >= 1."""
    log_density = lambda t: (a - 1.0) * F.log(t) + (b - 1.0) * F.log1p(-t)
    log_total = gamma_ln(a) + gamma_ln(b) - gamma_ln(a + b)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(over_interval(lambda t: F.exp(log_density(t) - log_total), F.lit(0.0), x, n))


# Normal family


def erfc_inverse(y: Column) -> Column:
    """The x of which erfc is y, 0 < y < 2."""
    return -normal_cdf_inverse(y / 2.0) / _ROOT2


def normal_cdf_ln(x: Column) -> Column:
    """ln normal_cdf(x), in the lower tail too."""
    low = F.log(erfcx(-x / _ROOT2) / 2.0) - x * x / 2.0
    return F.when(x < -1, low).otherwise(F.log1p(-erfc(x / _ROOT2) / 2.0))


def normal_cdf_logit(x: Column) -> Column:
    """ln of normal_cdf(x) / normal_cdf(-x)."""
    return normal_cdf_ln(x) - normal_cdf_ln(-x)


def normal_cdf_ratio(x: Column) -> Column:
    """normal_cdf(x) / normal_pdf(x); rounding x * x costs the last digits where it is large."""
    return erfcx(-x / _ROOT2) * math.sqrt(math.pi / 2)


def _large(x: Column) -> Column:
    """Where the last digits are worked out in pairs of doubles; beyond, the ratios are infinite."""
    return (x > 4.0) & (x < 40.0)


def _large_moment_ratio(n: int, x: Column) -> Column:
    """normal_cdf_moment_ratio as the nearest double, by its recurrence; the ratio is 1 / normal_pdf(x) less the one at -x."""

    def of(g: Column) -> Column:
        def start(m: pairs.Pair, k: Column) -> Column:
            one = F.pow(F.lit(2.0), -k)

            def after(j: int, before: pairs.Pair, now: pairs.Pair) -> Column:  # times j!
                if j == n:
                    return pairs.scaled(pairs.over(now, float(math.factorial(n))), k)
                product, added = pairs.times((g["x"], F.lit(0.0)), now), before if j < 2 else pairs.times((F.lit(float(j)), F.lit(0.0)), before)
                return pairs.held(product, lambda p: pairs.held(pairs.plus(p, added), lambda new: after(j + 1, now, new)))

            return pairs.held(pairs.plus(m, (-one * g["below"], F.lit(0.0))), lambda now: after(0, (one, F.lit(0.0)), now))

        return pairs.inverse_normal_pdf(g["x"], start)

    return bound(F.struct(x.alias("x"), normal_cdf_ratio(-x).alias("below")), of)


def nearest_normal_cdf_ratio(x: Column) -> Column:
    """normal_cdf(x) / normal_pdf(x), right to the last digit for large x too; the longer expression of the two."""
    return F.when(_large(x), _large_moment_ratio(0, x)).otherwise(normal_cdf_ratio(x))


def normal_cdf_ratio_ln(x: Column) -> Column:
    return F.when(x < 0, F.log(normal_cdf_ratio(x))).otherwise(normal_cdf_ln(x) + x * x / 2.0 + 0.5 * math.log(2 * math.pi))


def normal_cdf_ratio_diff(x: Column, delta: Column) -> Column:
    """normal_cdf_ratio(x + delta) - normal_cdf_ratio(x), as the integral of its slope x * ratio + 1."""
    return over_interval(lambda t: t * normal_cdf_ratio(t) + 1.0, x, x + delta, 16)


def normal_cdf_moment_ratio(n: int, x: Column) -> Column:
    """Integral over t > 0 of t**n / n! exp(x t - t*t/2)."""
    before, now = F.lit(1.0), normal_cdf_ratio(x)
    for k in range(n):
        before, now = now, (x * now + before) / float(k + 1)
    top = F.least(F.lit(14.0), F.lit(60.0) / F.greatest(-x, F.lit(1.0)))
    direct = over_interval(lambda t: F.pow(t, F.lit(float(n))) / float(math.factorial(n)) * F.exp(x * t - t * t / 2.0), F.lit(0.0), top, 64)
    return F.when(_large(x), _large_moment_ratio(n, x)).when(x >= 0, now).otherwise(direct)


def normal_cdf_moment_ratio_diff(n: int, x: Column, delta: Column) -> Column:
    """The difference of normal_cdf_moment_ratio at x + delta and x; its slope is (n + 1) times the next one."""
    return over_interval(lambda t: normal_cdf_moment_ratio(n + 1, t) * float(n + 1), x, x + delta, 8)


def normal_cdf_diff(x: Column, y: Column) -> Column:
    """normal_cdf(x) - normal_cdf(y), in the tail where neither is near 1."""
    return F.when((x > 0) & (y > 0), normal_cdf(-y) - normal_cdf(-x)).otherwise(normal_cdf(x) - normal_cdf(y))


def extended(log_value: Column) -> Column:
    """A positive number beyond the range of doubles as mantissa * exp(exponent), from its logarithm."""
    exponent = F.floor(log_value)
    return F.struct(F.exp(log_value - exponent).alias("mantissa"), exponent.cast("double").alias("exponent"))


def normal_cdf_extended(x: Column) -> Column:
    return extended(normal_cdf_ln(x))


def normal_cdf2(x: Column, y: Column, r: Column) -> Column:
    """Bivariate normal distribution function of correlation r, by the integral over the correlation's angle."""
    angle = F.asin(r)
    inner = over_interval(lambda t: F.exp((x * y * F.sin(t) * 2.0 - x * x - y * y) / (F.cos(t) * F.cos(t) * 2.0)), F.lit(0.0), angle, 48)
    p = normal_cdf(x) * normal_cdf(y) + inner / (2 * math.pi)
    return F.when(r >= 1, normal_cdf(F.least(x, y))).when(r <= -1, F.greatest(F.lit(0.0), normal_cdf(x) + normal_cdf(y) - 1.0)).otherwise(p)


def normal_cdf_integral(x: Column, y: Column, r: Column) -> Column:
    """Integral of normal_cdf2(t, y, r) over t up to x, for |r| < 1."""
    side = F.sqrt(F.lit(1.0) - r * r)
    return x * normal_cdf2(x, y, r) + normal_pdf(x) * normal_cdf((y - r * x) / side) + r * normal_pdf(y) * normal_cdf((x - r * y) / side)


def normal_cdf_integral_ratio(x: Column, y: Column, r: Column) -> Column:
    return normal_cdf_integral(x, y, r) / normal_cdf2(x, y, r)


# Logistic and exponential family


def log_ratio(x: Column, y: Column) -> Column:
    """ln(x / y); 0 where both are 0."""
    return F.when((x == 0) & (y == 0), 0.0).otherwise(F.log(x) - F.log(y))


def expm1_ratio_minus1_ratio_minus_half(x: Column) -> Column:
    """((exp(x) - 1) / x - 1) / x - 1/2, by its series near 0."""
    series = F.lit(0.0)
    for k in range(14, 2, -1):
        series = (series + 1.0 / math.factorial(k)) * x
    return F.when(F.abs(x) < 0.5, series).otherwise((F.expm1(x) / x - 1.0) / x - 0.5)


def difference_of_exp(x: Column, y: Column) -> Column:
    """exp(x) - exp(y) without cancellation."""
    return F.when(x >= y, -F.exp(x) * F.expm1(y - x)).otherwise(F.exp(y) * F.expm1(x - y))


def logit_from_log(x: Column) -> Column:
    """ln(p / (1 - p)) from ln p."""
    return x - log1m_exp(x)


def log_sum_exp(values: Column) -> Column:
    """ln of the sum of exp over an array; minus infinity of none."""

    def total(values: Column) -> Column:
        top = F.array_max(values)
        return top + F.log(F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp(v - top)))

    none = F.lit(float("-inf"))
    return F.when(F.size(values) == 0, none).when(F.array_max(values) == none, none).otherwise(bound(values, total))


def log_sum_exp_sparse(values: Column, common: Column, size: Column) -> Column:
    """log_sum_exp of ``size`` values of which all but those listed are ``common``."""
    rest = size - F.size(values)
    return F.when(rest <= 0, log_sum_exp(values)).otherwise(log_sum_exp(F.concat(values, F.array(common + F.log(rest.cast("double"))))))


def diff_log_sum_exp(x: Column, a: Column, b: Column) -> Column:
    """ln(e**x + e**a) - ln(e**x + e**b)."""
    return log1p_exp(a - x) - log1p_exp(b - x)


def softmax(values: Column) -> Column:
    """The probabilities of an array of log weights."""
    return bound(F.struct(values.alias("v"), log_sum_exp(values).alias("z")), lambda s: F.transform(s["v"], lambda v: F.exp(v - s["z"])))


def logistic_gaussian(mean: Column, variance: Column) -> Column:
    """Mean of the logistic function under a Gaussian."""
    return gaussian_mean_of(logistic, mean, variance)


def logistic_gaussian_derivative(mean: Column, variance: Column) -> Column:
    return gaussian_mean_of(lambda x: logistic(x) * logistic(-x), mean, variance)


def logistic_gaussian_derivative2(mean: Column, variance: Column) -> Column:
    return gaussian_mean_of(lambda x: logistic(x) * logistic(-x) * (F.lit(1.0) - logistic(x) * 2.0), mean, variance)


def logistic_gaussian_ratio(mean: Column, variance: Column, k: int) -> Column:
    """Mean of the logistic function (k = 0) or of its derivatives over the mean of the function times its complement."""
    top = (logistic_gaussian, logistic_gaussian_derivative, logistic_gaussian_derivative2)[k]
    return top(mean, variance) / logistic_gaussian(mean, variance)


def log1p_exp_gaussian(mean: Column, variance: Column) -> Column:
    """Mean of ln(1 + e**x) under a Gaussian."""
    return gaussian_mean_of(log1p_exp, mean, variance)


# Arrays, comparison, floating point


def index_of_maximum(values: Column) -> Column:
    """Place of the first largest element, from 0; -1 of an empty array."""
    return F.when(F.size(values) == 0, -1).otherwise(F.array_position(values, F.array_max(values)) - 1)


def index_of_minimum(values: Column) -> Column:
    return F.when(F.size(values) == 0, -1).otherwise(F.array_position(values, F.array_min(values)) - 1)


def remove_nans(values: Column) -> Column:
    return F.filter(values, lambda v: ~F.isnan(v))


def median(values: Column) -> Column:
    """The middle element, or the mean of both; null of none."""
    s = F.array_sort(values)
    lower, upper = F.try_element_at(s, F.floor((F.size(s) + 1) / 2).cast("int")), F.try_element_at(s, F.floor(F.size(s) / 2).cast("int") + 1)
    return F.when(F.size(values) == 0, None).otherwise((lower + upper) / 2.0)


def abs_diff(x: Column, y: Column, relative: float = 0.0) -> Column:
    """|x - y|, relative to the smaller magnitude plus ``relative`` if that is above 0; equal infinities differ by 0."""
    d = F.abs(x - y)
    return F.when(x == y, 0.0).otherwise(d / (F.least(F.abs(x), F.abs(y)) + relative) if relative else d)


def abs_diff_allowing_nans(x: Column, y: Column, relative: float = 0.0) -> Column:
    """abs_diff; two NaN differ by 0, one by infinity."""
    return F.when(F.isnan(x) & F.isnan(y), 0.0).when(F.isnan(x) | F.isnan(y), float("inf")).otherwise(abs_diff(x, y, relative))


def average(x: Column, y: Column) -> Column:
    """(x + y) / 2 without overflow."""
    return x / 2.0 + y / 2.0


def weighted_average(w1: Column, x1: Column, w2: Column, x2: Column) -> Column:
    return F.when(w1 + w2 == 0, average(x1, x2)).otherwise(x1 * (w1 / (w1 + w2)) + x2 * (w2 / (w1 + w2)))


def one_minus_sqrt_one_minus(x: Column) -> Column:
    """1 - sqrt(1 - x) without cancellation."""
    return x / (F.sqrt(F.lit(1.0) - x) + 1.0)


def _of_doubles(f, x: Column) -> Column:
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(f(values.to_numpy(float)))

    return F.pandas_udf(run, "double")(x)


def next_double(x: Column) -> Column:
    return _of_doubles(lambda v: np.nextafter(v, np.inf), x)


def previous_double(x: Column) -> Column:
    return _of_doubles(lambda v: np.nextafter(v, -np.inf), x)


def ulp(x: Column) -> Column:
    """The distance to the next larger double."""
    return _of_doubles(lambda v: np.spacing(np.abs(v)), x)
