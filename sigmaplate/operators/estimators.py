"""Estimators and accumulators as mergeable aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bound


def moments(data: DataFrame, keys: list[str], x: Column, weight: Column | None = None) -> DataFrame:
    """Weighted mean and population variance.

    The variance is taken about the mean, so nothing cancels where that is large: without weights by
    Spark's mergeable moments, with weights in a second pass.
    """
    if weight is None:
        return data.groupBy(*keys).agg(F.avg(x).alias("mean"), F.var_pop(x).alias("variance"))
    each = data.select(*keys, x.cast("double").alias("_x"), weight.cast("double").alias("_w"))
    means = each.groupBy(*keys).agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("mean"))
    near = F.col("_x") - F.col("mean")
    both = each.join(means, keys) if keys else each.join(F.broadcast(means))  # one row
    return both.groupBy(*keys, "mean").agg((F.sum(F.col("_w") * near * near) / F.sum("_w")).alias("variance"))


def moments_skip_nan(data: DataFrame, keys: list[str], x: Column) -> DataFrame:
    real = F.when(~F.isnan(x), x)
    return data.groupBy(*keys).agg(F.count(real).alias("n"), F.avg(real).alias("mean"), F.var_pop(real).alias("variance"))


def beta_by_moments(data: DataFrame, keys: list[str], x: Column) -> DataFrame:
    s = data.groupBy(*keys).agg(F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    total = F.col("m") * (F.lit(1.0) - F.col("m")) / F.col("v") - 1.0
    return s.select(*keys, (F.col("m") * total).alias("true_count"), ((F.lit(1.0) - F.col("m")) * total).alias("false_count"))


def gamma_by_moments(data: DataFrame, keys: list[str], x: Column) -> DataFrame:
    s = data.groupBy(*keys).agg(F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    return s.select(*keys, (F.col("m") * F.col("m") / F.col("v")).alias("shape"), (F.col("m") / F.col("v")).alias("rate"))


def histogram(data: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Counts and shares of each value."""
    counts = data.groupBy(*keys, value.alias("value")).agg(F.count("*").alias("n"))
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    return counts.select(*keys, "value", "n", (F.col("n") / F.sum("n").over(over)).alias("probability"))


def covariance(data: DataFrame, keys: list[str], vector: str, dimensions: int) -> DataFrame:
    """Population covariance of the first dimensions, a row for each pair i <= j."""
    pairs = [(i, j) for i in range(dimensions) for j in range(i, dimensions)]
    at = [F.col(vector)[i].cast("double") for i in range(dimensions)]
    sums = data.groupBy(*keys).agg(*[F.covar_pop(at[i], at[j]).alias(f"c{i}_{j}") for i, j in pairs])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}_{j}").alias("c")) for i, j in pairs])
    return sums.select(*keys, F.explode(cells).alias("cell")).select(*keys, "cell.i", "cell.j", F.col("cell.c").alias("covariance"))


#: Ranges that a column's values are dealt into for ranks.
RANGES = 256


def _ranked(data: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, x, c, upto, n): distinct values with their counts, the count up to and with them, and the key's count.

    Values fall into ranges between approximate quantiles of the key; running counts are taken in
    each range and offset by the ranges' own, so that a hot key fills many tasks.
    """
    data = data.where(F.col(x).isNotNull())
    bounds = data.groupBy(*keys).agg(F.percentile_approx(x, [k / RANGES for k in range(1, RANGES)], 1000).alias("bounds"))
    counts = data.groupBy(*keys, x).agg(F.count("*").alias("c"))
    counts = counts.join(bounds, keys) if keys else counts.join(F.broadcast(bounds))  # one row
    counts = counts.withColumn("range", F.size(F.filter("bounds", lambda b: b <= F.col(x)))).drop("bounds")
    sums = counts.groupBy(*keys, "range").agg(F.sum("c").alias("m"))
    w = Window.partitionBy(*keys)
    before = w.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "range", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"), F.sum("m").over(w).alias("n"))
    own = counts.withColumn("own", F.sum("c").over(Window.partitionBy(*keys, "range").orderBy(x)))
    return own.join(sums, [*keys, "range"]).select(*keys, x, "c", (F.col("base") + F.col("own")).alias("upto"), "n")


def quantiles(data: DataFrame, keys: list[str], x: str, probabilities: list[float]) -> DataFrame:
    """Exact sketch quantiles: the value at place min(floor(p * n), n - 1) of the sorted group."""
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    places = _ranked(data, keys, x).select(*keys, x, "c", "upto", "n", wanted.alias("p"))
    place = F.least(F.floor(F.col("p") * F.col("n")), F.col("n") - 1)
    return places.where((place < F.col("upto")) & (place >= F.col("upto") - F.col("c"))).select(*keys, "p", F.col(x).alias("quantile"))


def quantile_sketch(data: DataFrame, keys: list[str], x: str, probabilities: list[float], accuracy: int = 10_000) -> DataFrame:
    """Approximate quantiles by a mergeable summary of bounded size."""
    return data.groupBy(*keys).agg(F.percentile_approx(x, [float(p) for p in probabilities], accuracy).alias("quantiles"))


def interpolated_quantiles(data: DataFrame, keys: list[str], x: str, n: int, inner: bool) -> DataFrame:
    """n quantiles at (i + 1) / (n + 1) (inner) or i / (n - 1) (outer), linearly interpolated between neighbours."""
    p = [(i + 1) / (n + 1) if inner else i / (n - 1) for i in range(n)]
    wanted = F.posexplode(F.array(*[F.lit(v) for v in p])).alias("i", "p")
    places = _ranked(data, keys, x).select(*keys, x, "c", "upto", "n", wanted)
    at = F.col("p") * (F.col("n") - 1)
    first, second = F.floor(at), F.ceil(at)
    has = lambda k: (k < F.col("upto")) & (k >= F.col("upto") - F.col("c"))
    found = places.where(has(first) | has(second)).groupBy(*keys, "i").agg(
        F.max(F.when(has(first), F.col(x))).alias("low"), F.max(F.when(has(second), F.col(x))).alias("high"), F.max(at - first).alias("share")
    )
    return found.select(*keys, "i", (F.col("low") + (F.col("high") - F.col("low")) * F.col("share")).alias("quantile"))


def after_burn_in(samples: DataFrame, keys: list[str], iteration: str, burn_in: int, thin: int, x: Column) -> DataFrame:
    """Mean of kept samples: from burn_in on, every thin-th."""
    kept = samples.where((F.col(iteration) >= burn_in) & ((F.col(iteration) - burn_in) % thin == 0))
    return kept.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"))


def log_weighted_moments(data: DataFrame, keys: list[str], x: Column, log_weight: Column) -> DataFrame:
    """Mean and population variance under weights given by their logarithms, scaled by each key's largest."""
    each = data.select(*keys, x.cast("double").alias("_x"), log_weight.cast("double").alias("_l"))
    top = each.groupBy(*keys).agg(F.max("_l").alias("_top"))
    scaled = (each.join(top, keys) if keys else each.join(F.broadcast(top))).withColumn("_w", F.exp(F.col("_l") - F.col("_top")))
    return moments(scaled, keys, F.col("_x"), F.col("_w"))


def matrix_moments(data: DataFrame, keys: list[str], i: str, j: str, v: Column) -> DataFrame:
    """Elementwise mean and variance of matrices held as rows (i, j, v)."""
    return moments(data, [*keys, i, j], v)


def vector_moments(data: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Elementwise mean and variance of vectors."""
    each = data.select(*keys, F.posexplode(vector).alias("i", "_v"))
    return moments(each, [*keys, "i"], F.col("_v").cast("double"))


def dirichlet_by_moments(shares: DataFrame, keys: list[str], i: str, p: Column) -> DataFrame:
    """Pseudo-counts by moment matching of probabilities held as rows (i, p): the total from the first two moments of all elements."""
    s = shares.groupBy(*keys, i).agg(F.avg(p).alias("m"), F.avg(p * p).alias("q"))
    total = s.groupBy(*keys).agg((F.sum(F.col("m") - F.col("q")) / F.sum(F.col("q") - F.col("m") * F.col("m"))).alias("total"))
    both = s.join(total, keys) if keys else s.join(F.broadcast(total))  # one row
    return both.select(*keys, i, (F.col("m") * F.col("total")).alias("pseudo_count"))


def gamma_power_by_moments(data: DataFrame, keys: list[str], x: Column, power: float) -> DataFrame:
    """Shape, rate and power of x, whose root x ** (1 / power) is gamma."""
    return gamma_by_moments(data, keys, F.pow(x, F.lit(1.0 / power))).withColumn("power", F.lit(power))


def point_mass(data: DataFrame, keys: list[str], order: Column, x: Column) -> DataFrame:
    """The last value in an order."""
    return data.groupBy(*keys).agg(F.max_by(x, order).alias("point"))


def truncated_by_moments(data: DataFrame, keys: list[str], x: Column) -> DataFrame:
    """Mean and variance with the observed bounds beside them."""
    return data.groupBy(*keys).agg(F.avg(x).alias("mean"), F.var_pop(x).alias("variance"), F.min(x).alias("lower"), F.max(x).alias("upper"))


def wishart_by_moments(data: DataFrame, keys: list[str], xx: Column, xy: Column, yy: Column) -> DataFrame:
    """Shape and mean of 2x2 positive matrices (xx, xy; xy, yy): the shape is fitted to the variance of the diagonal."""
    s = data.groupBy(*keys).agg(*[f(c).alias(f"{n}{k}") for n, f in (("m", F.avg), ("v", F.var_pop)) for k, c in (("xx", xx), ("xy", xy), ("yy", yy))])
    shape = (F.col("mxx") * F.col("mxx") + F.col("myy") * F.col("myy")) / (F.col("vxx") + F.col("vyy"))
    return s.select(*keys, shape.alias("shape"), F.col("mxx").alias("xx"), F.col("mxy").alias("xy"), F.col("myy").alias("yy"))


def sample_list(samples: DataFrame, keys: list[str], iteration: str, x: str, burn_in: int = 0, thin: int = 1) -> DataFrame:
    """The kept samples as rows, numbered from 0: a table, as a list may be long."""
    kept = samples.where((F.col(iteration) >= burn_in) & ((F.col(iteration) - burn_in) % thin == 0))
    return kept.select(*keys, ((F.col(iteration) - burn_in) / thin).cast("long").alias("k"), x)


def mixture_of_components(components: DataFrame, keys: list[str], weight: Column, mean: Column, variance: Column) -> DataFrame:
    """Components as a list with normalised weights (the list is one key's, as long as its components are many), and the mixture's moments."""
    parts = F.collect_list(F.struct(mean.alias("mean"), variance.alias("variance"), weight.alias("weight")))
    total, first = F.sum(weight), F.sum(weight * mean) / F.sum(weight)
    s = components.groupBy(*keys).agg(F.sort_array(parts).alias("parts"), total.alias("total"), first.alias("mean"), (F.sum(weight * (variance + mean * mean)) / total - first * first).alias("variance"))
    return s.withColumn("parts", F.transform("parts", lambda p: F.struct(p["mean"].alias("mean"), p["variance"].alias("variance"), (p["weight"] / F.col("total")).alias("weight")))).drop("total")


def interpolate(points: Column, x: Column) -> Column:
    """The value at x of a broken line through points, an array of structs (x, y) by rising x; flat beyond its ends."""

    def value(g: Column) -> Column:
        below = F.filter(g["points"], lambda p: p["x"] <= g["x"])
        above = F.filter(g["points"], lambda p: p["x"] > g["x"])
        a, b = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
        inside = a["y"] + (b["y"] - a["y"]) * (g["x"] - a["x"]) / (b["x"] - a["x"])
        return F.when(F.size(below) == 0, b["y"]).when(F.size(above) == 0, a["y"]).otherwise(inside)

    return bound(F.struct(points.alias("points"), x.alias("x")), value)


def irregular_cdf(probabilities: list[float], quantiles: Column, x: Column) -> Column:
    """P(X < x) from quantiles at any probabilities, by linear interpolation."""
    points = F.zip_with(quantiles, F.array(*[F.lit(float(p)) for p in probabilities]), lambda q, p: F.struct(q.alias("x"), p.alias("y")))
    return interpolate(points, x)


def irregular_quantile(probabilities: list[float], quantiles: Column, p: Column) -> Column:
    points = F.zip_with(quantiles, F.array(*[F.lit(float(v)) for v in probabilities]), lambda q, v: F.struct(v.alias("x"), q.alias("y")))
    return interpolate(points, p)
