"""Bilinear recommender: user and item traits and biases by mean-field variational sweeps.

The affinity of a user and an item is the user's bias, the item's and the inner product of their
traits; a rating on a scale of whole numbers is the affinity, centred on the scale, plus Gaussian
noise.  Every trait and bias is an independent Gaussian.  A sweep updates one of them for all users
or all items: ratings join both sides' beliefs, and precision and mean are grouped sums of a row's
terms, pre-aggregated, so that a user or an item with very many ratings isn't gathered.  Beliefs are
keyed tables: (id, bias, bias_variance, traits, traits_variance), a prior mean per entity if given.

Ratings are predicted as probabilities of the levels: the normal probabilities between thresholds
halfway between neighbouring levels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import normal_cdf
from ..session import materialized


@dataclass(frozen=True)
class Settings:
    """Traits, sweeps, scale of the ratings and variances of priors and noise."""

    traits: int = 4
    sweeps: int = 5
    lowest: int = 1
    highest: int = 5
    trait_variance: float = 1.0
    bias_variance: float = 1.0
    noise: float = 1.0

    @property
    def centre(self) -> float:
        return (self.lowest + self.highest) / 2


@dataclass(frozen=True)
class Model:
    users: DataFrame
    items: DataFrame
    settings: Settings


def _start(keys: DataFrame, name: str, s: Settings, prior: DataFrame | None) -> DataFrame:
    """Prior beliefs; trait means start at small hashed values, as all zero is a saddle point."""
    number = F.col(name) if dict(keys.dtypes)[name] in ("int", "bigint") else F.crc32(F.col(name).cast("string"))
    place = lambda k: (F.pmod(F.pmod(number, F.lit(1 << 31)) * 2654435761 + k * 40503, F.lit(1000)) / 1000.0 - 0.5) * 0.2
    start = F.array(*[place(k + 1) for k in range(s.traits)])
    zero = F.array(*[F.lit(0.0)] * s.traits)
    table = keys.select(name, F.lit(0.0).alias("bias"), F.lit(s.bias_variance).alias("bias_variance"), start.alias("traits"), F.array(*[F.lit(s.trait_variance)] * s.traits).alias("traits_variance"))
    if prior is None:
        return table.withColumns({"prior_bias": F.lit(0.0), "prior_traits": zero})
    return table.join(prior, name, "left").withColumns({"prior_bias": F.coalesce("prior_bias", F.lit(0.0)), "prior_traits": F.coalesce("prior_traits", zero)})


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)


def _renamed(beliefs: DataFrame, key: str, mark: str) -> DataFrame:
    return beliefs.select(key, *[F.col(c).alias(f"{mark}_{c}") for c in ("bias", "bias_variance", "traits", "traits_variance")])


def _update(ratings: DataFrame, own: DataFrame, other: DataFrame, own_key: str, other_key: str, s: Settings) -> DataFrame:
    """New beliefs of one side: the bias first, then the traits one after the other, each from the row sums of one pass.

    The sums of a side are those of its design of bias and traits: the expected products of the
    other side's terms; the coordinate updates then need no further pass over the ratings.
    """
    rows = ratings.join(_renamed(other, other_key, "o"), other_key)
    t, v = F.col("o_traits"), F.col("o_traits_variance")
    left = F.col("rating") - s.centre - F.col("o_bias")
    cell = lambda i, j: t[i] * t[j] + v[i] if i == j else t[i] * t[j]
    sums = [F.count("*").cast("double").alias("n"), F.sum(left).alias("y")]
    for i in range(s.traits):
        sums += [F.sum(t[i]).alias(f"s{i}"), F.sum(left * t[i]).alias(f"y{i}")]
        sums += [F.sum(cell(i, j)).alias(f"s{i}_{j}") for j in range(i, s.traits)]
    got = own.join(rows.groupBy(own_key).agg(*sums), own_key, "left").fillna(0.0)
    # A coordinate update for each of bias and traits, in turn, from the current values of the others.
    state = got.withColumns({"b": F.col("bias"), **{f"t{i}": F.col("traits")[i] for i in range(s.traits)}})
    bias_precision = F.lit(1 / s.bias_variance) + F.col("n") / s.noise
    rest = sum((F.col(f"s{i}") * F.col(f"t{i}") for i in range(s.traits)), F.lit(0.0))
    state = state.withColumn("b", (F.col("prior_bias") / s.bias_variance + (F.col("y") - rest) / s.noise) / bias_precision)
    precisions = []
    for i in range(s.traits):
        precision = F.lit(1 / s.trait_variance) + F.col(f"s{i}_{i}") / s.noise
        rest = F.col("b") * F.col(f"s{i}") + sum((F.col(f"s{min(i, j)}_{max(i, j)}") * F.col(f"t{j}") for j in range(s.traits) if j != i), F.lit(0.0))
        state = state.withColumn(f"t{i}", (F.col("prior_traits")[i] / s.trait_variance + (F.col(f"y{i}") - rest) / s.noise) / precision)
        precisions.append(F.lit(1.0) / precision)
    return state.select(
        own_key, F.col("b").alias("bias"), (F.lit(1.0) / bias_precision).alias("bias_variance"), F.array(*[F.col(f"t{i}") for i in range(s.traits)]).alias("traits"),
        F.array(*precisions).alias("traits_variance"), "prior_bias", "prior_traits",
    )


def train(ratings: DataFrame, settings: Settings | None = None, user_prior: DataFrame | None = None, item_prior: DataFrame | None = None) -> Model:
    """Fit (user, item, rating); ids are whole numbers or text.

    priors: (id, prior_bias, prior_traits), such as those of ``feature_prior``.  A sweep updates
    all users, then all items; a sweep's beliefs are written tables, so that plans don't grow.
    """
    s = settings or Settings()
    ratings = materialized(ratings.select("user", "item", "rating"))
    users = _start(ratings.select("user").distinct(), "user", s, user_prior)
    items = materialized(_start(ratings.select("item").distinct(), "item", s, item_prior))
    for _ in range(s.sweeps):
        users = materialized(_update(ratings, users, items, "user", "item", s))
        items = materialized(_update(ratings, items, users, "item", "user", s))
    return Model(users, items, s)


def feature_prior(features: DataFrame, weights: DataFrame, key: str, traits: int) -> DataFrame:
    """Prior means from sparse features: features (key, feature, value) and weights (feature, bias, traits)."""
    rows = features.join(weights.select("feature", F.col("bias").alias("w"), F.col("traits").alias("t")), "feature")
    sums = [F.sum(F.col("value") * F.col("w")).alias("prior_bias"), *[F.sum(F.col("value") * F.col("t")[i]).alias(f"p{i}") for i in range(traits)]]
    return rows.groupBy(key).agg(*sums).select(key, "prior_bias", F.array(*[F.col(f"p{i}") for i in range(traits)]).alias("prior_traits"))


def _or_average(beliefs: DataFrame, keys: DataFrame, name: str, s: Settings) -> DataFrame:
    """Beliefs of the keys; a cold one has the average of all means, and the spread of means and variances as its variance."""
    mean = [F.avg("bias").alias("ab"), *[F.avg(F.col("traits")[i]).alias(f"a{i}") for i in range(s.traits)]]
    var = [(F.avg("bias_variance") + F.var_pop("bias")).alias("vb"), *[(F.avg(F.col("traits_variance")[i]) + F.var_pop(F.col("traits")[i])).alias(f"v{i}") for i in range(s.traits)]]
    average = F.broadcast(beliefs.agg(*mean, *var))  # one row
    both = keys.select(name).distinct().join(beliefs, name, "left").join(average)
    pick = lambda c, other: F.coalesce(F.col(c), other)
    return both.select(
        name, pick("bias", F.col("ab")).alias("bias"), pick("bias_variance", F.col("vb")).alias("bias_variance"),
        pick("traits", F.array(*[F.col(f"a{i}") for i in range(s.traits)])).alias("traits"), pick("traits_variance", F.array(*[F.col(f"v{i}") for i in range(s.traits)])).alias("traits_variance"),
    )


def affinities(pairs: DataFrame, model: Model) -> DataFrame:
    """pairs (user, item, ...) with mean and variance of the noisy affinity."""
    s = model.settings
    users = _renamed(_or_average(model.users, pairs, "user", s), "user", "u")
    items = _renamed(_or_average(model.items, pairs, "item", s), "item", "i")
    both = pairs.join(users, "user").join(items, "item")
    mean = F.col("u_bias") + F.col("i_bias") + _dot(F.col("u_traits"), F.col("i_traits")) + s.centre
    square = lambda c: F.transform(c, lambda x: x * x)
    spread = _dot(square("u_traits"), F.col("i_traits_variance")) + _dot(F.col("u_traits_variance"), square("i_traits")) + _dot(F.col("u_traits_variance"), F.col("i_traits_variance"))
    variance = F.col("u_bias_variance") + F.col("i_bias_variance") + spread + s.noise
    return both.select(*[F.col(c) for c in pairs.columns], mean.alias("mean"), variance.alias("variance"))


def predict_distribution(pairs: DataFrame, model: Model) -> DataFrame:
    """pairs with p, the array of the levels' probabilities, lowest first."""
    s = model.settings
    cut = [normal_cdf((F.lit(level + 0.5) - F.col("mean")) / F.sqrt("variance")) for level in range(s.lowest, s.highest)]
    steps = [F.lit(0.0), *cut, F.lit(1.0)]
    return affinities(pairs, model).withColumn("p", F.array(*[b - a for a, b in zip(steps[:-1], steps[1:], strict=True)])).drop("mean", "variance")


def predict(pairs: DataFrame, model: Model, loss: str = "zero_one") -> DataFrame:
    """pairs with rating: the level of least expected loss (zero_one: the mode, absolute: the median, squared: the mean's nearest)."""
    s = model.settings
    levels = range(s.lowest, s.highest + 1)
    cost = {"zero_one": lambda a, b: float(a != b), "absolute": lambda a, b: float(abs(a - b)), "squared": lambda a, b: float((a - b) ** 2)}[loss]
    each = predict_distribution(pairs, model)
    risks = [F.struct(sum((F.col("p")[k] * cost(a, b) for k, a in enumerate(levels)), F.lit(0.0)).alias("r"), F.lit(b).alias("rating")) for b in levels]
    return each.withColumn("rating", F.array_min(F.array(*risks))["rating"]).drop("p")


def expected_rating(pairs: DataFrame, model: Model) -> DataFrame:
    each = predict_distribution(pairs, model)
    s = model.settings
    return each.withColumn("expected", sum((F.col("p")[k] * float(level) for k, level in enumerate(range(s.lowest, s.highest + 1))), F.lit(0.0))).drop("p")


def recommend(pairs: DataFrame, model: Model, top: int) -> DataFrame:
    """The best items of each user among its pairs, by the mean of the predicted distribution; ties by item."""
    place = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("expected"), "item"))
    return expected_rating(pairs.select("user", "item").distinct(), model).withColumn("place", place).where(F.col("place") <= top)


def candidates(model: Model, users: DataFrame, seen: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """(user, item): every item of a catalogue for the given users, without what they have seen."""
    catalogue = (model.items if items is None else items).select("item").distinct()
    pairs = users.select("user").distinct().crossJoin(catalogue)
    return pairs if seen is None else pairs.join(seen.select("user", "item"), ["user", "item"], "left_anti")


def related(model: Model, queries: DataFrame, key: str, top: int) -> DataFrame:
    """For each query the entities most alike, itself excluded: ln of the density at 0 of the difference of two affinities
    to one and the same counterpart, whose traits have their average variance."""
    s = model.settings
    own, others = (model.users, model.items) if key == "user" else (model.items, model.users)
    spread = F.broadcast(others.agg(F.avg(F.aggregate("traits_variance", F.lit(0.0), lambda t, v: t + v) / s.traits).alias("spread")))  # one row
    q = own.join(queries.select(key).distinct(), key).select(F.col(key).alias("query"), F.col("bias").alias("qb"), F.col("traits").alias("qt"))
    both = q.join(own.select(key, "bias", "traits"), F.col("query") != F.col(key)).join(spread)
    distance = F.aggregate(F.zip_with("qt", "traits", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, v: t + v)
    v = F.lit(2 * s.noise) + distance * F.col("spread")
    gap = F.col("qb") - F.col("bias")
    score = -(F.log(v * 6.283185307179586) + gap * gap / v) / 2.0
    scored = both.select("query", F.col(key).alias("other"), score.alias("score"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "other"))).where(F.col("place") <= top)


def random_baseline(pairs: DataFrame, settings: Settings, seed: int = 1) -> DataFrame:
    """pairs with p, probabilities of the levels drawn uniformly: gaps of hashed uniform numbers by -ln u."""
    n = settings.highest - settings.lowest + 1
    u = [(F.pmod(F.xxhash64("user", "item", F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1) for k in range(n)]
    draws = F.array(*[-F.log(x) for x in u])
    return pairs.withColumn("p", F.transform(draws, lambda x: x / F.aggregate(draws, F.lit(0.0), lambda t, v: t + v)))
