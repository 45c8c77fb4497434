"""Posteriors of conjugate models: one grouped sum of sufficient statistics each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.families import beta_ln
from ..functions.scalar import gamma_ln


def gaussian_mean(data: DataFrame, keys: list[str], x: Column, prior_mean: float, prior_variance: float, noise_variance: float) -> DataFrame:
    """Posterior of a Gaussian mean with known noise: natural parameters add up."""
    sums = data.groupBy(*keys).agg(F.count(x).alias("n"), F.sum(x).alias("s"))
    prec = F.lit(1.0 / prior_variance) + F.col("n") / noise_variance
    tau = F.lit(prior_mean / prior_variance) + F.col("s") / noise_variance
    return sums.select(*keys, "n", (tau / prec).alias("mean"), (F.lit(1.0) / prec).alias("variance"))


def gaussian_gamma(data: DataFrame, keys: list[str], x: Column, m0: float, k0: float, shape0: float, rate0: float) -> DataFrame:
    """Posterior of mean and precision under a normal-gamma prior."""
    sums = data.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("avg"), F.var_pop(x).alias("var"))
    n, avg = F.col("n"), F.col("avg")
    k = n + k0
    rate = F.lit(rate0) + n * F.col("var") / 2.0 + (avg - m0) * (avg - m0) * n * k0 / (k * 2.0)
    return sums.select(
        *keys, "n", ((avg * n + k0 * m0) / k).alias("mean"), k.cast("double").alias("kappa"),
        (n / 2.0 + shape0).alias("shape"), rate.alias("rate"),
    )


def beta_bernoulli(data: DataFrame, keys: list[str], success: Column, a: float = 1.0, b: float = 1.0) -> DataFrame:
    """Posterior counts and mean of a Bernoulli rate, and the group's log evidence."""
    sums = data.groupBy(*keys).agg(F.sum(success.cast("long")).alias("yes"), F.count(success).alias("n"))
    pa, pb = F.col("yes") + a, F.col("n") - F.col("yes") + b
    return sums.select(
        *keys, pa.alias("true_count"), pb.alias("false_count"), (pa / (pa + pb)).alias("mean"),
        (beta_ln(pa, pb) - beta_ln(F.lit(a), F.lit(b))).alias("log_evidence"),
    )


def dirichlet_discrete(data: DataFrame, keys: list[str], value: str, prior: float = 1.0) -> DataFrame:
    """Posterior pseudo-counts of each value of a discrete variable by key.

    The domain is the values of the whole table; a value unseen under a key keeps its prior count,
    so that the result has a row for every key and value.
    """
    counts = data.groupBy(*keys, value).agg(F.count("*").alias("n"))
    domain = counts.select(value).distinct()
    size = domain.agg(F.count("*").alias("k"))  # one row
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total")).join(F.broadcast(size))
    cells = totals.crossJoin(domain).join(counts, [*keys, value], "left")
    pseudo = F.coalesce("n", F.lit(0)) + prior
    return cells.select(*keys, value, pseudo.alias("pseudo_count"), (pseudo / (F.col("total") + F.col("k") * prior)).alias("mean"))


def gamma_poisson(data: DataFrame, keys: list[str], count: Column, shape: float = 1.0, rate: float = 1.0) -> DataFrame:
    """Posterior of a Poisson rate under a gamma prior, and the log evidence up to the data's factorials."""
    sums = data.groupBy(*keys).agg(F.sum(count).alias("s"), F.count(count).alias("n"))
    a, b = F.col("s") + shape, F.col("n") + rate
    evidence = gamma_ln(a) - gamma_ln(F.lit(shape)) - a * F.log(b) + shape * F.log(F.lit(rate))
    return sums.select(*keys, a.cast("double").alias("shape"), b.cast("double").alias("rate"), (a / b).alias("mean"), evidence.alias("log_evidence"))


def linear_regression(data: DataFrame, keys: list[str], x: Column, y: Column, prior_precision: float, noise_variance: float) -> DataFrame:
    """Posterior mean of intercept and slope: a two-dimensional Gaussian from six sums."""
    s = data.groupBy(*keys).agg(
        F.count(x).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy")
    )
    v = noise_variance
    p00, p01, p11 = F.col("n") / v + prior_precision, F.col("sx") / v, F.col("sxx") / v + prior_precision
    t0, t1 = F.col("sy") / v, F.col("sxy") / v
    det = p00 * p11 - p01 * p01
    return s.select(*keys, "n", ((p11 * t0 - p01 * t1) / det).alias("intercept"), ((p00 * t1 - p01 * t0) / det).alias("slope"))


def gaussian_wishart2(data: DataFrame, keys: list[str], x: Column, y: Column, strength: float = 1.0, dof: float = 4.0) -> DataFrame:
    """Posterior of mean and precision of two dimensions under a normal-Wishart prior of mean 0 and unit scale.

    (mean_x, mean_y, precision_xx, precision_xy, log_det): the expected precision is the posterior
    degrees of freedom times the inverse of the scatter about the prior mean; log_det is the
    scatter's.
    """
    s = data.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy"))
    n, mx, my = F.col("n"), F.col("mx"), F.col("my")
    share = n * strength / (n + strength)
    s = s.withColumns({"s11": n * F.col("xx") + share * mx * mx + 1.0, "s12": n * F.col("xy") + share * mx * my, "s22": n * F.col("yy") + share * my * my + 1.0})
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    scale = (n + dof) / det
    return s.select(
        *keys, (n * mx / (n + strength)).alias("mean_x"), (n * my / (n + strength)).alias("mean_y"),
        (scale * F.col("s22")).alias("precision_xx"), (-scale * F.col("s12")).alias("precision_xy"), F.log(det).alias("log_det"),
    )
