"""Messages of the core factors as column expressions, forward and backward.

A Gaussian argument is its mean and variance.  A message that may be improper (a ratio of a
posterior and a prior) is a struct of natural parameters: tau, mean times precision, and prec.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bound, choose_ln, digamma, gamma_ln, logistic, normal_cdf, normal_pdf, trigamma
from ..functions.special import gamma_lower, logistic_gaussian, logistic_gaussian_derivative, normal_cdf_ln, normal_cdf_ratio, softmax

_ONE = 1.0


def natural(mean: Column, variance: Column) -> Column:
    return F.struct((mean / variance).alias("tau"), (F.lit(_ONE) / variance).alias("prec"))


def moments(message: Column) -> Column:
    """Struct of mean and variance of a proper message."""
    return F.struct((message["tau"] / message["prec"]).alias("mean"), (F.lit(_ONE) / message["prec"]).alias("variance"))


def ratio(mean: Column, variance: Column, prior_mean: Column, prior_variance: Column) -> Column:
    """The message that turns the prior into the posterior."""
    return F.struct((mean / variance - prior_mean / prior_variance).alias("tau"), (F.lit(_ONE) / variance - F.lit(_ONE) / prior_variance).alias("prec"))


def damped(old: Column, new: Column, step: float) -> Column:
    """old ** (1 - step) * new ** step, in natural parameters."""
    return F.struct(*[(old[p] * (1.0 - step) + new[p] * step).alias(p) for p in ("tau", "prec")])


def powered(message: Column, exponent: Column) -> Column:
    return F.struct(*[(message[p] * exponent).alias(p) for p in ("tau", "prec")])


# Gaussian factor


def gaussian_to_either(mean: Column, variance: Column, noise: Column) -> Column:
    """To the sample from the mean, and the other way, under a known noise variance."""
    return natural(mean, variance + noise)


def gaussian_variational(mean: Column, mean_precision: Column) -> Column:
    """Variational message to the sample, or the mean, from the other's mean and the precision's."""
    return F.struct((mean * mean_precision).alias("tau"), mean_precision.alias("prec"))


def precision_variational(x: Column, vx: Column, m: Column, vm: Column) -> Column:
    """Variational gamma message (shape, rate) to the precision."""
    return F.struct(F.lit(1.5).alias("shape"), ((vx + (x - m) * (x - m) + vm) / 2.0).alias("rate"))


def gaussian_average_log(x: Column, vx: Column, m: Column, vm: Column, shape: Column, rate: Column) -> Column:
    """Mean log density under independent beliefs; the precision's is gamma."""
    square = vx + (x - m) * (x - m) + vm
    return (digamma(shape) - F.log(rate) - math.log(2 * math.pi) - shape / rate * square) / 2.0


def gaussian_log_average(x: Column, vx: Column, m: Column, vm: Column) -> Column:
    """ln of the mean density: that of the difference at 0."""
    v = vx + vm
    return -(F.log(v * (2 * math.pi)) + (x - m) * (x - m) / v) / 2.0


# Linear maps


def difference_back(total: Column, v_total: Column, other: Column, v_other: Column) -> Column:
    """To one term of a sum from the sum and the rest."""
    return natural(total - other, v_total + v_other)


def sum_except(values: Column) -> Column:
    """For each element the sum of the others."""
    return bound(F.struct(values.alias("v"), F.aggregate(values, F.lit(0.0), lambda s, x: s + x).alias("s")), lambda g: F.transform(g["v"], lambda x: g["s"] - x))


def max_of_others(values: Column) -> Column:
    """For each element the largest of the others; null of a single one."""
    ranked = F.sort_array(values, asc=False)
    first, second = F.try_element_at(ranked, F.lit(1)), F.try_element_at(ranked, F.lit(2))
    best = F.array_position(values, first)
    return F.transform(values, lambda x, i: F.when(i + 1 == best, second).otherwise(first))


# Products


def product_moments(a: Column, va: Column, b: Column, vb: Column) -> Column:
    """Mean and variance of a product of independent variables."""
    return F.struct((a * b).alias("mean"), (va * b * b + vb * a * a + va * vb).alias("variance"))


def product_back(tau: Column, prec: Column, b: Column, vb: Column) -> Column:
    """Variational message to one factor from the product's message and the other factor."""
    return F.struct((tau * b).alias("tau"), (prec * (b * b + vb)).alias("prec"))


def product_exp_moments(a: Column, va: Column, b: Column, vb: Column) -> Column:
    """Mean and variance of a * exp(b)."""
    mean = a * F.exp(b + vb / 2.0)
    return F.struct(mean.alias("mean"), ((va + a * a) * F.exp(b * 2.0 + vb * 2.0) - mean * mean).alias("variance"))


def ratio_moments(a: Column, va: Column, b: Column) -> Column:
    """a over a known divisor."""
    return F.struct((a / b).alias("mean"), (va / (b * b)).alias("variance"))


def inner_product_moments(a: Column, va: Column, b: Column, vb: Column) -> Column:
    """Of two vectors of independent elements, given as arrays of means and variances."""
    terms = F.arrays_zip(a.alias("a"), va.alias("va"), b.alias("b"), vb.alias("vb"))
    zero = F.struct(F.lit(0.0).alias("mean"), F.lit(0.0).alias("variance"))

    def add(s: Column, t: Column) -> Column:
        v = t["va"] * t["b"] * t["b"] + t["vb"] * t["a"] * t["a"] + t["va"] * t["vb"]
        return F.struct((s["mean"] + t["a"] * t["b"]).alias("mean"), (s["variance"] + v).alias("variance"))

    return F.aggregate(terms, zero, add)


def rotated(x: Column, y: Column, angle: Column) -> Column:
    return F.struct((x * F.cos(angle) - y * F.sin(angle)).alias("x"), (x * F.sin(angle) + y * F.cos(angle)).alias("y"))


# Constraints and comparisons


def _projected(mean: Column, variance: Column, slope: Column, curve: Column) -> Column:
    """Posterior mean and variance from the slope of ln Z in the mean, and less its second derivative."""
    return F.struct((mean + variance * slope).alias("mean"), (variance - variance * variance * curve).alias("variance"))


def positive_log_odds(mean: Column, variance: Column) -> Column:
    """Forward: log odds that a Gaussian is positive."""
    return bound(mean / F.sqrt(variance), lambda z: normal_cdf_ln(z) - normal_cdf_ln(-z))


def positive_posterior(mean: Column, variance: Column, p: Column | None = None) -> Column:
    """The Gaussian's moments given evidence p that it is positive (certainty by default)."""

    def slopes(z: Column) -> Column:
        density = normal_pdf(z)
        if p is None:
            v = F.lit(_ONE) / normal_cdf_ratio(z)
        else:
            v = density * (p * 2.0 - 1.0) / (F.lit(_ONE) - p + (p * 2.0 - 1.0) * normal_cdf(z))
        return bound(v, lambda v: _projected(mean, variance, v / F.sqrt(variance), v * (v + z) / variance))

    return bound(mean / F.sqrt(variance), slopes)


def greater_posteriors(ma: Column, va: Column, mb: Column, vb: Column) -> Column:
    """Moments of a and b given that a > b, and the log probability of that."""

    def value(z: Column) -> Column:
        def use(v: Column) -> Column:
            s = F.sqrt(va + vb)
            curve = v * (v + z) / (va + vb)
            return F.struct(
                normal_cdf_ln(z).alias("log_evidence"), (ma + va * v / s).alias("mean_a"), (va - va * va * curve).alias("variance_a"),
                (mb - vb * v / s).alias("mean_b"), (vb - vb * vb * curve).alias("variance_b"),
            )

        return bound(F.lit(_ONE) / normal_cdf_ratio(z), use)

    return bound((ma - mb) / F.sqrt(va + vb), value)


def max_back(m: Column, v: Column, a: Column, va: Column, b: Column, vb: Column) -> Column:
    """Moments of a given the message (m, v) of max(a, b): a is the larger, or b is."""

    def value(g: Column) -> Column:
        def side(own: str, other: Column, v_other: Column) -> tuple[Column, Column, Column]:
            """Log weight, and standardised gap and its scale, of the case that ``own`` is the larger."""
            scale = F.sqrt(g[f"v{own}"] + v_other)
            z = (g[f"m{own}"] - other) / scale
            return g[f"l{own}"] + normal_cdf_ln(z), z, scale

        la, za, sa = side("1", b, vb)
        lb, zb, sb = side("2", a, va)
        ra, rb = F.lit(_ONE) / normal_cdf_ratio(za), F.lit(_ONE) / normal_cdf_ratio(zb)
        mean1 = g["m1"] + g["v1"] * ra / sa
        var1 = g["v1"] - g["v1"] * g["v1"] * ra * (ra + za) / (sa * sa)
        mean2 = a - va * rb / sb
        var2 = va - va * va * rb * (rb + zb) / (sb * sb)
        w = logistic(la - lb)
        mean = w * mean1 + (F.lit(_ONE) - w) * mean2
        square = w * (var1 + mean1 * mean1) + (F.lit(_ONE) - w) * (var2 + mean2 * mean2)
        return F.struct(mean.alias("mean"), (square - mean * mean).alias("variance"))

    def merged(x: Column, vx: Column, k: str) -> list[Column]:
        total = v + vx
        return [((m * vx + x * v) / total).alias(f"m{k}"), (v * vx / total).alias(f"v{k}"), gaussian_log_average(m, v, x, vx).alias(f"l{k}")]

    return bound(F.struct(*merged(a, va, "1"), *merged(b, vb, "2")), value)


# Exponential, logarithm, powers


def exp_moments(mean: Column, variance: Column) -> Column:
    """Gamma (shape, rate) that matches the moments of exp of a Gaussian."""
    square = F.expm1(variance)
    return F.struct((F.lit(_ONE) / square).alias("shape"), (F.exp(-mean - variance / 2.0) / square).alias("rate"))


def log_moments(shape: Column, rate: Column) -> Column:
    """Mean and variance of the logarithm of a gamma variable."""
    return F.struct((digamma(shape) - F.log(rate)).alias("mean"), trigamma(shape).alias("variance"))


def power_mean(shape: Column, rate: Column, exponent: Column) -> Column:
    """Mean of a gamma variable's power."""
    return F.exp(gamma_ln(shape + exponent) - gamma_ln(shape) - exponent * F.log(rate))


def logistic_beta(mean: Column, variance: Column) -> Column:
    """Beta (true count, false count) that matches the moments of the logistic function of a Gaussian."""

    def value(g: Column) -> Column:
        spread = g["m"] - g["d"] - g["m"] * g["m"]  # mean of the square, as the derivative is p (1 - p)
        total = g["m"] * (F.lit(_ONE) - g["m"]) / spread - 1.0
        return F.struct((g["m"] * total).alias("true_count"), ((F.lit(_ONE) - g["m"]) * total).alias("false_count"))

    return bound(F.struct(logistic_gaussian(mean, variance).alias("m"), logistic_gaussian_derivative(mean, variance).alias("d")), value)


# Gamma, beta, Dirichlet


def gamma_rate_back(shape: Column, sample: Column) -> Column:
    """Gamma message to the rate from an observed sample."""
    return F.struct((shape + 1.0).alias("shape"), sample.alias("rate"))


def poisson_rate_back(count: Column) -> Column:
    return F.struct((count + 1.0).alias("shape"), F.lit(1.0).alias("rate"))


def truncated_gamma_moments(shape: Column, rate: Column, lower: Column, upper: Column) -> Column:
    """Probability between the bounds, and the mean and variance there."""
    between = lambda k: gamma_lower(shape + k, rate * upper) - gamma_lower(shape + k, rate * lower)

    def value(g: Column) -> Column:
        mean = shape / rate * g["first"] / g["p"]
        square = shape * (shape + 1.0) / (rate * rate) * g["second"] / g["p"]
        return F.struct(g["p"].alias("probability"), mean.alias("mean"), (square - mean * mean).alias("variance"))

    return bound(F.struct(between(0.0).alias("p"), between(1.0).alias("first"), between(2.0).alias("second")), value)


def beta_from_mean_and_total(mean: Column, total: Column) -> Column:
    p = F.struct((mean * total).alias("true_count"), ((F.lit(_ONE) - mean) * total).alias("false_count"), (mean * (F.lit(_ONE) - mean) / (total + 1.0)).alias("variance"))
    return p


def beta_from_moments(mean: Column, variance: Column) -> Column:
    return beta_from_mean_and_total(mean, mean * (F.lit(_ONE) - mean) / variance - 1.0)


def gamma_from_moments(mean: Column, variance: Column) -> Column:
    return F.struct((mean * mean / variance).alias("shape"), (mean / variance).alias("rate"))


def dirichlet_mean(pseudo_counts: Column) -> Column:
    return bound(F.struct(pseudo_counts.alias("c"), F.aggregate(pseudo_counts, F.lit(0.0), lambda s, x: s + x).alias("s")), lambda g: F.transform(g["c"], lambda x: x / g["s"]))


def dirichlet_variational(pseudo_counts: Column) -> Column:
    """Discrete message proportional to exp of the mean log probabilities."""
    return softmax(F.transform(pseudo_counts, digamma))


def dirichlet_from_mean_and_total(mean: Column, total: Column) -> Column:
    return F.transform(mean, lambda m: m * total)


# Discrete factors


def count_true(p: Column) -> Column:
    """Distribution of the number of true ones among independent conditions, given as an array of probabilities."""

    def add(d: Column, q: Column) -> Column:
        zero = F.array(F.lit(0.0))
        return F.zip_with(F.concat(d, zero), F.concat(zero, d), lambda stay, rise: stay * (F.lit(_ONE) - q) + rise * q)

    return F.aggregate(p, F.array(F.lit(1.0)), add)


def bernoulli_from_discrete(weights: Column, p: Column) -> Column:
    """Probability of true, that of each case weighted."""
    return F.aggregate(F.zip_with(weights, p, lambda w, q: w * q), F.lit(0.0), lambda s, x: s + x)


def discrete_from_bernoulli(message: Column, p: Column) -> Column:
    """Back to the cases from evidence for true."""
    return dirichlet_mean(F.transform(p, lambda q: message * q + (F.lit(_ONE) - message) * (F.lit(_ONE) - q)))


def not_back(p: Column) -> Column:
    return F.lit(_ONE) - p


def equal_back(result: Column, other: Column) -> Column:
    """To one side of an equality from evidence that it holds."""
    return result * other + (F.lit(_ONE) - result) * (F.lit(_ONE) - other)


def bernoulli_from_log_odds(mean: Column, variance: Column) -> Column:
    return logistic_gaussian(mean, variance)


def binomial_log_probability(n: Column, k: Column, p: Column) -> Column:
    return choose_ln(n, k) + k * F.log(p) + (n - k) * F.log1p(-p)


def multinomial_log_probability(counts: Column, p: Column) -> Column:
    n = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    terms = F.zip_with(counts, p, lambda c, q: F.when(c > 0, c * F.log(q) - gamma_ln(c + 1.0)).otherwise(0.0))
    return gamma_ln(n + 1.0) + F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def best_under_penalty(scores: Column, penalty) -> Column:
    """Max-sum message over a pairwise potential: for each label j the largest of score_i - penalty(i, j)."""
    return F.transform(scores, lambda _, j: F.array_max(F.transform(scores, lambda s, i: s - penalty(i, j))))


def potts(weight: float):
    return lambda i, j: F.when(i == j, 0.0).otherwise(weight)


def linear(weight: float):
    return lambda i, j: F.abs(i - j) * weight


def linear_truncated(weight: float, most: float):
    return lambda i, j: F.least(F.abs(i - j) * weight, F.lit(float(most)))


# Gates


def gate_cases(p: Column) -> Column:
    """Log probabilities of the cases true and false."""
    return F.array(F.log(p), F.log1p(-p))


def gate_cases_back(log_evidence: Column) -> Column:
    """Log odds of the condition from the cases' log evidences."""
    return log_evidence[0] - log_evidence[1]


def gate_selector_back(log_evidence: Column) -> Column:
    """The selector's distribution from the cases' log evidences."""
    return softmax(log_evidence)


def _mixture(weights: Column, mean: Column, variance: Column) -> Column:
    terms = F.arrays_zip(weights.alias("w"), mean.alias("m"), variance.alias("v"))
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("m", "s")])
    return F.aggregate(
        terms, zero,
        lambda s, t: F.struct((s["m"] + t["w"] * t["m"]).alias("m"), (s["s"] + t["w"] * (t["v"] + t["m"] * t["m"])).alias("s")),
        lambda s: F.struct(s["m"].alias("mean"), (s["s"] - s["m"] * s["m"]).alias("variance")),
    )


def gate_exit(log_cases: Column, mean: Column, variance: Column, to_exit_mean: Column, to_exit_variance: Column) -> Column:
    """Moments of a variable that leaves a gate: each case's message times what comes back, weighted and matched.

    log_cases, mean, variance: arrays by case.  The message forward is this over what came back.
    """

    def value(g: Column) -> Column:
        weights = softmax(F.transform(g, lambda t: t["l"]))
        return _mixture(weights, F.transform(g, lambda t: t["m"]), F.transform(g, lambda t: t["v"]))

    joined = F.transform(
        F.arrays_zip(log_cases.alias("c"), mean.alias("m"), variance.alias("v")),
        lambda t: F.struct(
            (t["c"] + gaussian_log_average(t["m"], t["v"], to_exit_mean, to_exit_variance)).alias("l"),
            ((t["m"] * to_exit_variance + to_exit_mean * t["v"]) / (t["v"] + to_exit_variance)).alias("m"),
            (t["v"] * to_exit_variance / (t["v"] + to_exit_variance)).alias("v"),
        ),
    )
    return bound(joined, value)


def gate_power(weights: Column, tau: Column, prec: Column) -> Column:
    """Variational messages through a gate: the product of the cases' messages to the power of their weights."""
    dot = lambda x: F.aggregate(F.zip_with(weights, x, lambda w, y: w * y), F.lit(0.0), lambda s, y: s + y)
    return F.struct(dot(tau).alias("tau"), dot(prec).alias("prec"))


def gate_enter_back(weights: Column, mean: Column, variance: Column, value_mean: Column, value_variance: Column) -> Column:
    """Posterior of a variable that enters a gate, from the messages that come back from its cases."""
    return gate_exit(F.transform(weights, lambda w: F.log(w)), mean, variance, value_mean, value_variance)


# Collections, as keyed rows


def get_items(array: DataFrame, index: DataFrame, on: str) -> DataFrame:
    """array[index]: each row of index with its element; nested and jagged index lists are further key columns of index."""
    return index.join(array, on)


def get_items_back(messages: DataFrame, on: str, parameters: list[str]) -> DataFrame:
    """To each element the product of the messages from the places that took it."""
    return messages.groupBy(on).agg(*[F.sum(p).alias(p) for p in parameters])


def subarray(array: DataFrame, position: str, start: Column, count: Column) -> DataFrame:
    """Rows from start on, renumbered."""
    return array.where((F.col(position) >= start) & (F.col(position) < start + count)).withColumn(position, F.col(position) - start)


def split(values: Column, at: Column) -> Column:
    """Head and tail of an array."""
    return F.struct(F.slice(values, F.lit(1), at).alias("head"), F.slice(values, at + 1, F.greatest(F.size(values) - at, F.lit(0))).alias("tail"))


def sparse_list(domain: DataFrame, exceptions: DataFrame, key: str, value: str, default) -> DataFrame:
    """A list with a common value: every key of the domain, and the value of those that have their own."""
    return domain.join(exceptions, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))

