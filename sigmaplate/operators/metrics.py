"""Evaluation metrics of classifiers, rankings and recommenders.

A curve over a table needs running sums over its scores.  They are taken over distinct scores, and
by score ranges: sums of ranges come first, so no window has to hold the table in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Equal-width ranges of the score that running sums are dealt into.
RANGES = 256


def pointwise(data: DataFrame, keys: list[str], truth: Column, predicted: Column) -> DataFrame:
    d = truth - predicted
    return data.groupBy(*keys).agg(
        F.avg((truth != predicted).cast("double")).alias("zero_one_error"),
        F.avg(d * d).alias("squared_error"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.avg(F.abs(d)).alias("absolute_error"),
    )


def negative_log_probability(data: DataFrame, keys: list[str], positive: Column, p: Column) -> DataFrame:
    loss = -F.log(F.when(positive, p).otherwise(F.lit(1.0) - p))
    return data.groupBy(*keys).agg(F.avg(loss).alias("negative_log_probability"))


def _tie_groups(data: DataFrame, keys: list[str], positive: Column, score: Column) -> DataFrame:
    """For each distinct score: its positives and negatives, and those of all higher scores.

    Scores lie in 0..1.
    """
    groups = data.groupBy(*keys, score.alias("score")).agg(F.sum(positive.cast("long")).alias("p"), F.sum((~positive).cast("long")).alias("n"))
    groups = groups.withColumn("range", F.least(F.floor(F.col("score") * RANGES), F.lit(RANGES - 1)).cast("int"))
    sums = groups.groupBy(*keys, "range").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))
    higher = Window.partitionBy(*keys).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "range", *[F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(c) for c in ("rp", "rn")])
    within = Window.partitionBy(*keys, "range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    own = groups.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"own_{c}") for c in ("p", "n")])
    return own.join(sums, [*keys, "range"]).select(
        *keys, "score", "p", "n", (F.col("rp") + F.col("own_p")).alias("tp"), (F.col("rn") + F.col("own_n")).alias("fp")
    )


def area_under_roc(data: DataFrame, keys: list[str], positive: Column, score: Column) -> DataFrame:
    """Trapezoids over tie groups; null without both classes."""
    g = _tie_groups(data, keys, positive, score)
    area = F.sum(F.col("n") * (F.col("tp") + F.col("p") / 2.0))
    return g.groupBy(*keys).agg(F.try_divide(area, F.sum("p") * F.sum("n")).alias("auc"))


def roc_curve(data: DataFrame, keys: list[str], positive: Column, score: Column) -> DataFrame:
    """(score, fpr, tpr): (0, 0) with a null score, then a point for each distinct score, ties together; the last is (1, 1).

    Rates are null for a key without positives or without negatives.
    """
    g = _tie_groups(data, keys, positive, score)
    totals = g.groupBy(*keys).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    points = g.select(*keys, "score", (F.col("fp") + F.col("n")).alias("fp"), (F.col("tp") + F.col("p")).alias("tp"))
    none = F.lit(0).cast("long")
    points = points.unionByName(totals.select(*keys, F.lit(None).cast("double").alias("score"), none.alias("fp"), none.alias("tp")))
    both = points.join(totals, keys) if keys else points.join(F.broadcast(totals))  # one row
    return both.select(*keys, "score", F.try_divide("fp", "all_n").alias("fpr"), F.try_divide("tp", "all_p").alias("tpr"))


def precision_recall_curve(data: DataFrame, keys: list[str], positive: Column, score: Column, tie: Column) -> DataFrame:
    """(score, tie, precision, recall): (1, 0) with null score and tie, then a point for each row by falling score.

    Rows of one score come by tie % 64 and tie, a whole number that tells them apart; such a score
    is dealt into 64 parts, so that no task holds all of it.  A key without positives has null recall.
    """
    each = data.select(*keys, positive.alias("yes"), score.alias("score"), tie.alias("tie"), F.pmod(tie, F.lit(64)).alias("part"))
    higher = _tie_groups(data, keys, positive, score).select(*keys, "score", "tp", "fp")
    parts = each.groupBy(*keys, "score", "part").agg(F.sum(F.col("yes").cast("long")).alias("p"), F.count("*").alias("c"))
    before = Window.partitionBy(*keys, "score").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in ("p", "c")]
    starts = parts.select(*keys, "score", "part", *earlier).join(higher, [*keys, "score"])
    within = Window.partitionBy(*keys, "score", "part").orderBy("tie").rowsBetween(Window.unboundedPreceding, 0)
    run = each.select("*", F.sum(F.col("yes").cast("long")).over(within).alias("p"), F.count("*").over(within).alias("c"))
    run = run.join(starts, [*keys, "score", "part"])
    points = run.select(*keys, "score", "tie", (F.col("tp") + F.col("before_p") + F.col("p")).alias("hits"), (F.col("tp") + F.col("fp") + F.col("before_c") + F.col("c")).alias("taken"))
    totals = each.groupBy(*keys).agg(F.sum(F.col("yes").cast("long")).alias("all_p"))
    start = totals.select(*keys, F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("tie"), F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("taken"))
    points = points.unionByName(start)
    both = points.join(totals, keys) if keys else points.join(F.broadcast(totals))  # one row
    precision = F.when(F.col("taken") == 0, 1.0).otherwise(F.try_divide("hits", "taken"))
    recall = F.when(F.col("taken") == 0, 0.0).otherwise(F.try_divide("hits", "all_p"))
    return both.select(*keys, "score", "tie", precision.alias("precision"), recall.alias("recall"))


def confusion_matrix(data: DataFrame, truth: str, predicted: str) -> DataFrame:
    return data.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def per_label(confusion: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each label; null where undefined, F1 0 where both are 0."""
    cells = F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("h")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("h")),
    )
    s = confusion.select(F.explode(cells).alias("c")).groupBy("c.label").agg(F.sum("c.t").alias("t"), F.sum("c.p").alias("p"), F.sum("c.h").alias("h"))
    precision, recall = F.try_divide(F.col("h"), F.col("p")), F.try_divide(F.col("h"), F.col("t"))
    both = precision + recall
    return s.select("label", "t", precision.alias("precision"), recall.alias("recall"), F.when(both == 0, 0.0).otherwise(precision * recall * 2.0 / both).alias("f1"))


def averages(labels: DataFrame) -> DataFrame:
    """Micro (weighted by support) and macro averages over the labels where they are defined."""
    out = []
    for m in ("precision", "recall", "f1"):
        weight = F.when(F.col(m).isNotNull(), F.col("t"))
        out += [(F.sum(F.col(m) * F.col("t")) / F.sum(weight)).alias(f"micro_{m}"), F.avg(m).alias(f"macro_{m}")]
    return labels.agg(*out, F.count("f1").alias("labels"))


def hand_till(data: DataFrame, truth: str, scores: dict[str, Column]) -> DataFrame:
    """Mean over ordered pairs of labels of the pair's area under the curve; NaN if a pair lacks one of its labels."""
    pairs = [(a, b) for a in scores for b in scores if a != b]
    cells = F.array(*[F.struct(F.lit(f"{a}|{b}").alias("pair"), F.lit(a).alias("a"), F.lit(b).alias("b"), (scores[a] / (scores[a] + scores[b])).alias("s")) for a, b in pairs])
    each = data.select(F.col(truth).cast("string").alias("truth"), F.explode(cells).alias("c")).where((F.col("truth") == F.col("c.a")) | (F.col("truth") == F.col("c.b")))
    each = each.select("c.pair", (F.col("truth") == F.col("c.a")).alias("yes"), F.coalesce("c.s", F.lit(0.0)).alias("s"))
    areas = area_under_roc(each, ["pair"], F.col("yes"), F.col("s"))
    return areas.agg(F.when(F.count("auc") < len(pairs), float("nan")).otherwise(F.avg("auc")).alias("m_measure"))


def calibration(data: DataFrame, positive: Column, p: Column, bins: int, least: int = 1) -> DataFrame:
    b = F.least(F.floor(p * bins), F.lit(bins - 1))
    g = data.groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"), F.avg(positive.cast("double")).alias("empirical"))
    return g.where(F.col("n") >= least).select("bin", "n", ((F.col("bin") + 0.5) / bins).alias("center"), "empirical")


def ranked_gain(data: DataFrame, user: str, gain: Column, order: list[Column], linear: bool = False) -> DataFrame:
    """DCG, its best and NDCG of each user's list; order must be total."""
    w = Window.partitionBy(user)
    g = data.select(user, gain.cast("double").alias("gain"), F.row_number().over(w.orderBy(*order)).alias("r"))
    g = g.withColumn("best", F.row_number().over(w.orderBy(F.desc("gain"), "r")))
    discount = (lambda c: F.lit(1.0) / F.col(c)) if linear else (lambda c: F.lit(1.0) / F.log2(F.col(c) + 1.0))
    s = g.groupBy(user).agg(F.sum(F.col("gain") * discount("r")).alias("dcg"), F.sum(F.col("gain") * discount("best")).alias("ideal"))
    return s.select(user, "dcg", F.try_divide("dcg", "ideal").alias("ndcg"))


def graded_average_precision(data: DataFrame, user: str, gain: Column, order: list[Column]) -> DataFrame:
    """Sum over places i of the mean over j <= i of min(g_i, g_j), over the sum of gains; null where that is 0.

    Gains are any numbers from 0 on.  A user's list is folded as one array, in the square of its length.
    """
    step = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], gain.cast("double").alias("g"))
    lists = data.groupBy(user).agg(F.transform(F.sort_array(F.collect_list(step)), lambda s: s["g"]).alias("g"))
    upto = lambda i, v: F.aggregate(F.slice("g", F.lit(1), i), F.lit(0.0), lambda s, w: s + F.least(v, w)) / i
    terms = F.aggregate(F.transform("g", lambda v, i: upto(i + 1, v)), F.lit(0.0), lambda s, t: s + t)
    total = F.aggregate("g", F.lit(0.0), lambda s, v: s + v)
    return lists.select(user, F.try_divide(terms, total).alias("gap"))


def similarities(data: DataFrame, keys: list[str], a: Column, b: Column) -> DataFrame:
    """Cosine, Pearson, and normalised Euclidean and Manhattan similarity of two columns."""
    d = a - b
    return data.groupBy(*keys).agg(
        (F.sum(a * b) / F.sqrt(F.sum(a * a) * F.sum(b * b))).alias("cosine"),
        F.corr(a, b).alias("pearson"),
        (F.lit(1.0) / (F.sqrt(F.avg(d * d)) + 1.0)).alias("euclidean"),
        (F.lit(1.0) / (F.avg(F.abs(d)) + 1.0)).alias("manhattan"),
    )


def per_user_first(data: DataFrame, user: str, metric: Column) -> DataFrame:
    """The metric as the mean over pairs and as the mean of the users' means."""
    g = data.groupBy(user).agg(F.avg(metric).alias("m"), F.sum(metric).alias("s"), F.count(metric).alias("n"))
    return g.agg((F.sum("s") / F.sum("n")).alias("over_pairs"), F.avg("m").alias("over_users"))


def least_expected_loss(distribution: DataFrame, row: str, value: str, p: str, support: list[int], loss: str) -> DataFrame:
    """The point of the support with the least expected loss, ties to the least."""
    costs = {"absolute": lambda c: F.abs(F.col(value) - c), "squared": lambda c: F.pow(F.col(value) - c, F.lit(2.0)), "zero_one": lambda c: (F.col(value) != c).cast("double")}
    agg = distribution.groupBy(row).agg(*[F.sum(F.col(p) * costs[loss](F.lit(c))).alias(f"c{c}") for c in support])
    best = F.array_min(F.array(*[F.struct(F.round(F.col(f"c{c}"), 12).alias("cost"), F.lit(c).alias("value")) for c in support]))
    return agg.select(row, best["value"].alias("estimate"), best["cost"].alias("expected_loss"))


# Recommendation lists and rating distributions


def rated_item_lists(recommended: DataFrame, ratings: DataFrame, min_pool: int) -> DataFrame:
    """Recommended items with their true rating as gain, for users who rated at least ``min_pool`` items."""
    rated = ratings.groupBy("user").agg(F.count("*").alias("pool")).where(F.col("pool") >= min_pool).select("user")
    return recommended.join(rated, "user", "left_semi").join(ratings.select("user", "item", F.col("rating").alias("gain")), ["user", "item"])


def recommendation_ndcg(lists: DataFrame, ratings: DataFrame, top: int) -> DataFrame:
    """(user, ndcg): the list's gains by place against the user's largest ratings in falling order, as many as the list is long."""
    w = Window.partitionBy("user")
    best = ratings.select("user", F.col("rating").cast("double").alias("g"), F.row_number().over(w.orderBy(F.desc("rating"), "item")).alias("r")).where(F.col("r") <= top)
    got = lists.select("user", F.col("gain").cast("double").alias("g"), F.row_number().over(w.orderBy("place", "item")).alias("r"))
    gain = F.sum(F.col("g") / F.log2(F.col("r") + 1.0))
    n = got.groupBy("user").agg(gain.alias("dcg"), F.max("r").alias("n"))
    ideal = best.join(n.select("user", "n"), "user").where(F.col("r") <= F.col("n")).groupBy("user").agg(gain.alias("ideal"))
    return n.join(ideal, "user").select("user", F.try_divide("dcg", "ideal").alias("ndcg"))


def co_rated(ratings: DataFrame, key: str, over: str, min_common: int) -> DataFrame:
    """(a, b, common, similarity): pairs a < b of one side with enough common counterparts; similarity is 1 / (1 + mean |difference|).

    A pair of a counterpart's raters is made once; hot counterparts are split by AQE, as the join is on their key.
    """
    x, y = ratings.alias("x"), ratings.alias("y")
    both = x.join(y, (F.col(f"x.{over}") == F.col(f"y.{over}")) & (F.col(f"x.{key}") < F.col(f"y.{key}")))
    s = both.groupBy(F.col(f"x.{key}").alias("a"), F.col(f"y.{key}").alias("b")).agg(F.count("*").alias("common"), F.avg(F.abs(F.col("x.rating") - F.col("y.rating"))).alias("d"))
    return s.where(F.col("common") >= min_common).select("a", "b", "common", (F.lit(1.0) / (F.col("d") + 1.0)).alias("similarity"))


def related_ndcg(found: DataFrame, pairs: DataFrame, top: int) -> DataFrame:
    """(query, ndcg) of related entities (query, other, place) against the similarity of common ratings, pairs a < b."""
    both = pairs.select(F.col("a").alias("query"), F.col("b").alias("other"), "similarity").unionByName(pairs.select(F.col("b").alias("query"), F.col("a").alias("other"), "similarity"))
    lists = found.join(both, ["query", "other"]).select(F.col("query").alias("user"), F.col("other").alias("item"), "place", F.col("similarity").alias("gain"))
    best = both.select(F.col("query").alias("user"), F.col("other").alias("item"), F.col("similarity").alias("rating"))
    return recommendation_ndcg(lists, best, top).withColumnRenamed("user", "query")


def normalised_confusion(data: DataFrame, truth: str, predicted: str, user: str | None = None) -> DataFrame:
    """Shares of (truth, predicted): of all rows or, with a user column, of each user first and then their mean."""
    if user is None:
        c = confusion_matrix(data, truth, predicted)
        return c.join(F.broadcast(c.agg(F.sum("n").alias("_t")))).select("truth", "predicted", (F.col("n") / F.col("_t")).alias("share"))  # one row
    per = data.groupBy(user, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    totals = per.groupBy(user).agg(F.sum("n").alias("_t"))
    users = totals.agg(F.count("*").alias("_u"))  # one row
    shares = per.join(totals, user).groupBy("truth", "predicted").agg(F.sum(F.col("n") / F.col("_t")).alias("s"))
    return shares.join(F.broadcast(users)).select("truth", "predicted", (F.col("s") / F.col("_u")).alias("share"))


def weighted_confusion(confusion: DataFrame, loss: Column) -> DataFrame:
    """Sum of shares times a loss of truth and predicted."""
    return confusion.agg(F.sum(F.col("share") * loss).alias("loss"))


def expected_metric(distribution: DataFrame, keys: list[str], p: str, lowest: int, loss) -> DataFrame:
    """Mean over rows of the expectation of loss(truth, level) under p, an array of the levels' probabilities; truth is ``rating``."""
    risk = F.aggregate(F.transform(p, lambda q, k: q * loss(F.col("rating"), k + lowest)), F.lit(0.0), lambda s, v: s + v)
    return distribution.groupBy(*keys).agg(F.avg(risk).alias("expected"))


def calibration_error(curve: DataFrame) -> DataFrame:
    """Mean distance of a calibration curve from its bins' centres; null of no bins."""
    return curve.agg(F.avg(F.abs(F.col("empirical") - F.col("center"))).alias("error"))
