"""Commands over files: ``python -m sigmaplate.cli recommender train --data ratings.txt --model m`` and so on.

Recommender files have the lines of ``sources.formats.read_recommender``, classifier files those of
``read_labelled``.  Every command reads its inputs, runs one query of the library and writes its output.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .learners import classifier
from .learners import recommender as bilinear
from .operators import metrics, recommender
from .sources import formats, persistence

COMMANDS: dict[tuple[str, ...], tuple[Callable, list[tuple[str, dict]]]] = {}


def command(*path: str, **arguments):
    """Register a command; an argument without a default is required."""

    def register(f: Callable) -> Callable:
        COMMANDS[path] = (f, [(n, {"required": True, "type": str} if d is None else {"default": d, "type": type(d)}) for n, d in arguments.items()])
        return f

    return register


def _ratings(spark: SparkSession, path: str) -> DataFrame:
    return formats.read_recommender(spark, path)["ratings"]


def _settings(spark: SparkSession, args) -> bilinear.Settings:
    low, high = formats.read_recommender(spark, args.data)["range"].first() or (1.0, 5.0)
    return bilinear.Settings(args.traits, args.sweeps, int(low), int(high))


def _write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.select("user", "item", "rating").write.mode("overwrite").csv(path)


@command("recommender", "split-data", data=None, train=None, test=None, cold_items=0.0, cold_users=0.0, train_only_users=0.5, train_fraction=0.25, ignored_items=0.0, ignored_users=0.0)
def split_data(spark, args) -> None:
    dealt = recommender.split(
        _ratings(spark, args.data), args.cold_items, args.cold_users, args.train_only_users, args.train_fraction, args.ignored_items, args.ignored_users
    ).persist()
    _write_pairs(dealt.where("fold = 'train'"), args.train)
    _write_pairs(dealt.where("fold = 'test'"), args.test)


@command("recommender", "generate-negative-data", data=None, output=None)
def generate_negative_data(spark, args) -> None:
    liked = _ratings(spark, args.data).select("user", "item")
    negatives = recommender.histogram_negatives(liked)
    _write_pairs(liked.withColumn("rating", F.lit(1)).unionByName(negatives.withColumn("rating", F.lit(0))), args.output)


@command("recommender", "train", data=None, model=None, traits=4, sweeps=5)
def train_recommender(spark, args) -> None:
    persistence.save_recommender(bilinear.train(_ratings(spark, args.data), _settings(spark, args)), args.model)


@command("recommender", "predict-ratings", data=None, model=None, predictions=None, loss="zero_one")
def predict_ratings(spark, args) -> None:
    model = persistence.load_recommender(spark, args.model)
    _write_pairs(bilinear.predict(_ratings(spark, args.data).select("user", "item"), model, args.loss), args.predictions)


@command("recommender", "recommend-items", data=None, model=None, predictions=None, top=5)
def recommend_items(spark, args) -> None:
    model, users = persistence.load_recommender(spark, args.model), _ratings(spark, args.data)
    formats.write_ranked(bilinear.recommend(bilinear.candidates(model, users), model, args.top), args.predictions, "user", "item", "place")


def _related(spark, args, key: str) -> None:
    found = bilinear.related(persistence.load_recommender(spark, args.model), _ratings(spark, args.data), key, args.top)
    formats.write_ranked(found, args.predictions, "query", "other", "place")


@command("recommender", "find-related-users", data=None, model=None, predictions=None, top=5)
def find_related_users(spark, args) -> None:
    _related(spark, args, "user")


@command("recommender", "find-related-items", data=None, model=None, predictions=None, top=5)
def find_related_items(spark, args) -> None:
    _related(spark, args, "item")


def _report(spark: SparkSession, report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


@command("recommender", "evaluate-rating-prediction", data=None, predictions=None, report=None)
def evaluate_rating_prediction(spark, args) -> None:
    truth = _ratings(spark, args.data)
    both = truth.join(formats.read_ratings(spark, args.predictions).select("user", "item", F.col("rating").alias("predicted")), ["user", "item"])
    error = F.abs(F.col("rating") - F.col("predicted"))
    _report(spark, metrics.pointwise(both, [], F.col("rating"), F.col("predicted")).join(metrics.per_user_first(both, "user", error)), args.report)


@command("recommender", "evaluate-item-recommendation", data=None, predictions=None, report=None, top=5, min_pool=1)
def evaluate_item_recommendation(spark, args) -> None:
    truth = _ratings(spark, args.data)
    lists = metrics.rated_item_lists(persistence.read_ranked(spark, args.predictions, "user", "item", "place"), truth, args.min_pool)
    gap = metrics.graded_average_precision(lists, "user", F.col("gain"), [F.col("place")]).agg(F.avg("gap").alias("graded_average_precision"))
    _report(spark, metrics.recommendation_ndcg(lists, truth, args.top).agg(F.avg("ndcg").alias("ndcg")).join(gap), args.report)


def _evaluate_related(spark, args, key: str, over: str) -> None:
    pairs = metrics.co_rated(_ratings(spark, args.data), key, over, args.min_common)
    found = persistence.read_ranked(spark, args.predictions, "query", "other", "place")
    _report(spark, metrics.related_ndcg(found, pairs, args.top).agg(F.avg("ndcg").alias("ndcg"), F.count("*").alias("queries")), args.report)


@command("recommender", "evaluate-find-related-users", data=None, predictions=None, report=None, top=5, min_common=1)
def evaluate_related_users(spark, args) -> None:
    _evaluate_related(spark, args, "user", "item")


@command("recommender", "evaluate-find-related-items", data=None, predictions=None, report=None, top=5, min_common=1)
def evaluate_related_items(spark, args) -> None:
    _evaluate_related(spark, args, "item", "user")


def _labelled(spark: SparkSession, path: str, names: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """(row, label, a column for each feature); the features are those of the file unless given."""
    rows = formats.read_labelled(spark, path)
    if names is None:
        names = sorted(r[0] for r in rows.select(F.explode(F.map_keys("features"))).distinct().collect())  # the model's features
    columns = [F.coalesce(F.try_element_at("features", F.lit(n)), F.lit(0.0)).alias(f"x_{n}") for n in names]
    return rows.select(F.monotonically_increasing_id().alias("row"), "label", *columns), [f"x_{n}" for n in names]


def _names(models: dict) -> list[str]:
    return [f[2:] for f in next(iter(models.values())).features]


def _train(spark, args, binary: bool, prior: dict | None = None) -> dict:
    data, names = _labelled(spark, args.data, None if prior is None else _names(prior))
    labels = sorted(r[0] for r in data.select("label").distinct().collect()) if prior is None else list(prior)
    if binary and prior is None and len(labels) != 2:
        raise ValueError(f"a binary classifier needs 2 labels, not {labels}")
    wanted = labels[1:] if binary and prior is None else labels
    return classifier.train_multiclass(data, names, "label", wanted, args.sweeps, prior)


def _predictions(spark, args) -> tuple[DataFrame, dict]:
    models = persistence.load_classifier(spark, args.model)
    data, _ = _labelled(spark, args.data, _names(models))
    if len(models) == 1:
        (label,) = models
        p = classifier.predict(data, models[label])
        return p.withColumn("p", F.create_map(F.lit(label), F.col("p"), F.lit(f"not {label}"), F.lit(1.0) - F.col("p"))), models
    return classifier.predict_multiclass(data, models), models


def _classifier_commands(kind: str, binary: bool) -> None:
    @command("classifier", kind, "train", data=None, model=None, sweeps=20)
    def train(spark, args) -> None:
        persistence.save_classifier(spark, _train(spark, args, binary), args.model)

    @command("classifier", kind, "train-incremental", data=None, input_model=None, model=None, sweeps=20)
    def train_incremental(spark, args) -> None:
        prior = persistence.load_classifier(spark, args.input_model)
        persistence.save_classifier(spark, _train(spark, args, binary, prior), args.model)

    @command("classifier", kind, "predict", data=None, model=None, predictions=None)
    def predict(spark, args) -> None:
        persistence.write_label_distributions(_predictions(spark, args)[0], args.predictions, "row")

    @command("classifier", kind, "cross-validate", data=None, report=None, folds=5, sweeps=20)
    def cross_validate(spark, args) -> None:
        data, names = _labelled(spark, args.data)
        dealt = classifier.cross_validation_folds(data, "row", args.folds).persist()
        labels, out = sorted(r[0] for r in data.select("label").distinct().collect()), None
        for k in range(args.folds):
            models = classifier.train_multiclass(dealt.where(F.col("fold") != k), names, "label", labels, args.sweeps)
            part = classifier.predict_multiclass(dealt.where(F.col("fold") == k), models)
            part = part.groupBy("fold").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"), F.avg(-F.log(F.col("p")[F.col("label")])).alias("negative_log_probability"))
            out = part if out is None else out.unionByName(part)
        _report(spark, out.orderBy("fold"), args.report)

    @command("classifier", kind, "sample-weights", model=None, samples=None, count=10, seed=0)
    def sample_weights(spark, args) -> None:
        rows = [
            (label, k, name, float(v))
            for label, w in persistence.load_classifier(spark, args.model).items()
            for k, draw in enumerate(classifier.sample_weights(w, args.count, args.seed))
            for name, v in zip([*w.features, "bias"], draw, strict=True)
        ]
        _report(spark, spark.createDataFrame(rows, "label string, sample int, feature string, weight double"), args.samples)

    @command("classifier", kind, "diagnose-train", data=None, report=None, sweeps=20)
    def diagnose_train(spark, args) -> None:
        rows = [(label, k, e, m) for label, w in _train(spark, args, binary).items() for k, (e, m) in enumerate(zip(w.evidence, w.moved, strict=True))]
        _report(spark, spark.createDataFrame(rows, "label string, sweep int, evidence double, moved double"), args.report)


_classifier_commands("binary", True)
_classifier_commands("multiclass", False)


@command("classifier", "evaluate", data=None, predictions=None, report=None)
def evaluate_classifier(spark, args) -> None:
    """Precision, recall, F1 and area under the curve of each label, from label distributions in the order of the data's lines."""
    truth = classifier.numbered(formats.read_labelled(spark, args.data).select(F.monotonically_increasing_id().alias("row"), "label"), ["row"])
    found = classifier.numbered(persistence.read_label_distributions(spark, args.predictions), ["row"])
    both = truth.select("number", "label").join(found.select("number", "p"), "number")
    best = F.array_max(F.transform(F.map_entries("p"), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("label"))))["label"]
    per = metrics.per_label(metrics.confusion_matrix(both.withColumn("predicted", best), "label", "predicted"))
    each = both.select("label", F.explode("p").alias("of", "score"))
    areas = metrics.area_under_roc(each, ["of"], F.col("label") == F.col("of"), F.col("score")).withColumnRenamed("of", "label")
    _report(spark, per.join(areas, "label", "left").orderBy("label"), args.report)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sigmaplate")
    groups = {(): top.add_subparsers(required=True)}
    for path, (run, arguments) in COMMANDS.items():
        for k in range(1, len(path)):
            if path[:k] not in groups:
                groups[path[:k]] = groups[path[: k - 1]].add_parser(path[k - 1]).add_subparsers(required=True)
        leaf = groups[path[:-1]].add_parser(path[-1], help=(run.__doc__ or "").split("\n")[0])
        for name, options in arguments:
            leaf.add_argument("--" + name.replace("_", "-"), **options)
        leaf.set_defaults(run=run)
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(arguments)
    args.run(spark or SparkSession.builder.appName("sigmaplate").getOrCreate(), args)


if __name__ == "__main__":
    main()
