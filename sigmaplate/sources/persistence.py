"""Trained models and label distributions as files."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..learners.classifier import Weights
from ..learners.recommender import Model, Settings


def save_recommender(model: Model, path: str) -> None:
    """Users, items and settings as Parquet tables of a folder; columns may be added later, as readers take them by name."""
    model.users.write.mode("overwrite").parquet(f"{path}/users")
    model.items.write.mode("overwrite").parquet(f"{path}/items")
    settings = model.users.sparkSession.createDataFrame([(json.dumps(vars(model.settings)),)], "settings string")
    settings.coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def load_recommender(spark: SparkSession, path: str) -> Model:
    (line,) = spark.read.text(f"{path}/settings").first()
    return Model(spark.read.parquet(f"{path}/users"), spark.read.parquet(f"{path}/items"), Settings(**json.loads(line)))


def save_classifier(spark: SparkSession, models: dict[str, Weights], path: str) -> None:
    """A row for each label's weights, as JSON."""
    rows = [(label, json.dumps({"features": w.features, "mean": w.mean.tolist(), "covariance": w.covariance.tolist()})) for label, w in models.items()]
    spark.createDataFrame(rows, "label string, weights string").coalesce(1).write.mode("overwrite").json(path)


def load_classifier(spark: SparkSession, path: str) -> dict[str, Weights]:
    out = {}
    for r in spark.read.schema("label string, weights string").json(path).collect():
        w = json.loads(r["weights"])
        out[r["label"]] = Weights(w["features"], np.array(w["mean"]), np.array(w["covariance"]))
    return out


def write_label_distributions(predictions: DataFrame, path: str, row: str) -> None:
    """A line for each row, "label=p label=p", in the order of ``row``; p is a map."""
    parts = F.transform(F.array_sort(F.map_entries("p")), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string")))
    predictions.orderBy(row).select(F.array_join(parts, " ").alias("value")).write.mode("overwrite").text(path)


def read_label_distributions(spark: SparkSession, path: str) -> DataFrame:
    """(row, p): a map of label to probability for each line; row numbers the lines of the files in order."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("row"), "value")
    parts = F.transform(F.split("value", " "), lambda t: F.struct(F.split(t, "=")[0].alias("key"), F.split(t, "=")[1].cast("double").alias("value")))
    return lines.select("row", F.map_from_entries(parts).alias("p"))


def read_csv_columns(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header as columns of strings."""
    return spark.read.option("header", True).csv(path)


def read_ranked(spark: SparkSession, path: str, query: str, item: str, place: str) -> DataFrame:
    """(query, item, place) from lines of a query and its list, separated by commas."""
    parts = spark.read.text(path).select(F.split("value", ",").alias("v"))
    rows = parts.select(F.col("v")[0].alias(query), F.posexplode(F.slice("v", 2, F.size("v") - 1)).alias("k", item))
    return rows.select(query, item, (F.col("k") + 1).alias(place))
