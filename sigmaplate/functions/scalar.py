"""Special functions as JVM-side column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logit(p: Column) -> Column:
    return F.log(p) - F.log1p(-p)


def log1p_exp(x: Column) -> Column:
    """ln(1 + e**x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def log_sum_exp_over(x: Column, w: WindowSpec) -> Column:
    top = F.max(x).over(w)
    return top + F.log(F.sum(F.exp(x - top)).over(w))


def softmax_over(x: Column, w: WindowSpec) -> Column:
    return F.exp(x - log_sum_exp_over(x, w))


def gamma_ln(x: Column) -> Column:
    """ln Gamma(x) for x > 0: the argument is shifted above 8 by the recurrence, then Stirling's series."""
    product = F.lit(1.0)
    for k in range(8):
        product = product * (x + float(k))
    z = x + 8.0
    w, series = F.lit(1.0) / (z * z), F.lit(0.0)
    for k, b in zip((5, 4, 3, 2, 1), (5 / 66, -1 / 30, 1 / 42, -1 / 30, 1 / 6), strict=True):  # Bernoulli numbers B10..B2
        series = series * w + b / (2 * k * (2 * k - 1))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series / z - F.log(product)


def digamma(x: Column) -> Column:
    """Derivative of gamma_ln, by the same shift and series."""
    shifted = F.lit(0.0)
    for k in range(8):
        shifted = shifted + F.lit(1.0) / (x + float(k))
    z = x + 8.0
    w, series = F.lit(1.0) / (z * z), F.lit(0.0)
    for k, b in zip((5, 4, 3, 2, 1), (5 / 66, -1 / 30, 1 / 42, -1 / 30, 1 / 6), strict=True):
        series = (series + b / (2 * k)) * w
    return F.log(z) - F.lit(0.5) / z - series - shifted


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def signed_round(value: Column, digits: int) -> Column:
    """F.round, but what is rounded to zero keeps its sign, as in SQL."""
    return bound(value, lambda v: F.when(v < 0, -F.round(-v, digits)).otherwise(F.round(v, digits)))


#: W. J. Cody's rational approximations of the error function (Math. Comp. 23, 1969), numerator and
#: denominator from the highest power down: erf(x) / x in x*x up to 0.46875, exp(x*x) erfc(x) in x up to 4 and, beyond,
#: its distance from 1 / (x sqrt(pi)) in 1 / (x*x).
_NEAR = (
    (1.85777706184603153e-1, 3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03),
    (1.0, 2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03),
)
_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e00, 6.61191906371416295e01, 2.98635138197400131e02,
     8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03),
    (1.0, 1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03,
     3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03),
)
_FAR = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)


def polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    """Horner's scheme, the highest power first."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def _ratio(x: Column, of: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
    return polynomial(x, of[0]) / polynomial(x, of[1])


def _scaled(y: Column) -> Column:
    """exp(y*y) erfc(y) for y >= 0.46875."""
    u = F.lit(1.0) / (y * y)
    far = (F.lit(1 / math.sqrt(math.pi)) - u * _ratio(u, _FAR)) / y
    return F.when(y <= 4.0, _ratio(y, _MIDDLE)).otherwise(far)


def erfc(x: Column) -> Column:
    """Complementary error function."""

    def value(x: Column) -> Column:
        y = F.abs(x)
        tail = F.exp(-y * y) * _scaled(y)
        return F.when(y <= 0.46875, F.lit(1.0) - x * _ratio(x * x, _NEAR)).when(x < 0, F.lit(2.0) - tail).otherwise(tail)

    return bound(x, value)


def erfcx(x: Column) -> Column:
    """exp(x*x) erfc(x), which doesn't underflow for large x."""
    return bound(x, lambda x: F.when(x >= 0.46875, _scaled(x)).otherwise(F.exp(x * x) * erfc(x)))


def normal_cdf(x: Column) -> Column:
    return erfc(-x / math.sqrt(2.0)) * 0.5


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2.0) / math.sqrt(2 * math.pi)


def trigamma(x: Column) -> Column:
    """Second derivative of gamma_ln, by the same shift and series."""
    shifted = F.lit(0.0)
    for k in range(8):
        shifted = shifted + F.lit(1.0) / ((x + float(k)) * (x + float(k)))
    z = x + 8.0
    series = F.lit(0.0)
    for k, b in enumerate((1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66), 1):
        series = series + F.lit(b) / F.pow(z, F.lit(2.0 * k + 1))
    return F.lit(1.0) / z + F.lit(0.5) / (z * z) + series + shifted


def choose_ln(n: Column, k: Column) -> Column:
    """ln of the binomial coefficient, for real 0 <= k <= n."""
    return gamma_ln(n + 1.0) - gamma_ln(k + 1.0) - gamma_ln(n - k + 1.0)


def rising_factorial_ln(x: Column, n: Column) -> Column:
    """ln of x (x + 1) ... (x + n - 1), for x > 0."""
    return gamma_ln(x + n) - gamma_ln(x)


def logistic_ln(x: Column) -> Column:
    return -log1p_exp(-x)


def log1m_exp(x: Column) -> Column:
    """ln(1 - e**x) for x < 0, exact at both ends."""
    return F.when(x > -math.log(2.0), F.log(-F.expm1(x))).otherwise(F.log1p(-F.exp(x)))


def log_expm1(x: Column) -> Column:
    """ln(e**x - 1) for x > 0, without overflow."""
    return x + log1m_exp(-x)


def log_difference_of_exp(x: Column, y: Column) -> Column:
    """ln(e**x - e**y) for x > y."""
    return x + log1m_exp(y - x)


#: P. J. Acklam's rational approximation of the normal quantile, in the middle and in the lower tail.
_CENTRE = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
)
_TAIL = (
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)


def normal_cdf_inverse(p: Column) -> Column:
    """The x of which normal_cdf is p; infinite at 0 and 1, null outside.

    A rational approximation and two of Halley's steps, in the lower tail, where no digits are lost.
    """

    def refined(p: Column, x: Column) -> Column:
        def step(x: Column) -> Column:
            u = (normal_cdf(x) - p) / normal_pdf(x)
            return bound(u, lambda u: x - u / (x * u / 2.0 + 1.0))

        return bound(bound(x, step), step)

    def below_half(p: Column) -> Column:
        q = p - 0.5
        root = F.sqrt(F.log(p) * -2.0)
        start = F.when(p < 0.02425, bound(root, lambda r: _ratio(r, _TAIL))).otherwise(bound(q, lambda q: q * _ratio(q * q, _CENTRE)))
        return bound(start, lambda x: refined(p, x))

    def value(p: Column) -> Column:
        x = bound(bound(F.least(p, F.lit(1.0) - p), below_half), lambda x: F.when(p <= 0.5, x).otherwise(-x))
        return F.when(p == 0, float("-inf")).when(p == 1, float("inf")).when((p > 0) & (p < 1), x)

    return bound(p, value)
