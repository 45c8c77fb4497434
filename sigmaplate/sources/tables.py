"""The relational layout of recommender data, and datasets derived from sales tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..learners.classifier import numbered

#: Columns of the tables of a recommender dataset.
SCHEMAS = {
    "Feature": "FeatureID long, FeatureName string",
    "Item": "ID long, ItemID string",
    "User": "ID long, UserID string",
    "ItemFeature": "ItemID long, FeatureID long, FeatureValue string",
    "UserFeature": "UserID long, FeatureID long, FeatureValue string",
    "UserItemRating": "UserID string, ItemID string, Rating decimal(5,2)",
}


def create(spark: SparkSession, database: str) -> None:
    """Empty tables of a database."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in SCHEMAS.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def normalised(ratings: DataFrame, item_features: DataFrame, user_features: DataFrame) -> dict[str, DataFrame]:
    """All tables from ratings (user, item, rating) and features (item or user, feature, value): entities and features get numbers in their order."""
    number = lambda df, key: numbered(df.select(F.col(key).cast("string").alias(key)).distinct(), [key], "ID")
    items, users = number(ratings.select("item"), "item"), number(ratings.select("user"), "user")
    names = item_features.select("feature").unionByName(user_features.select("feature"))
    features = number(names, "feature")

    def of(rows: DataFrame, entities: DataFrame, key: str, out: str) -> DataFrame:
        both = rows.select(F.col(key).cast("string").alias(key), "feature", "value").join(entities, key).withColumnRenamed("ID", out)
        return both.join(features.withColumnRenamed("ID", "FeatureID"), "feature").select(out, "FeatureID", F.col("value").cast("string").alias("FeatureValue"))

    return {
        "Feature": features.select(F.col("ID").alias("FeatureID"), F.col("feature").alias("FeatureName")),
        "Item": items.select("ID", F.col("item").alias("ItemID")),
        "User": users.select("ID", F.col("user").alias("UserID")),
        "ItemFeature": of(item_features, items, "item", "ItemID"),
        "UserFeature": of(user_features, users, "user", "UserID"),
        "UserItemRating": ratings.select(F.col("user").cast("string").alias("UserID"), F.col("item").cast("string").alias("ItemID"), F.col("rating").cast("decimal(5,2)").alias("Rating")),
    }


def write_dataset(ratings: DataFrame, item_features: DataFrame, user_features: DataFrame, path: str, lowest: int, highest: int) -> None:
    """A recommender dataset as text lines: the range, entities with their features, ratings."""
    spark = ratings.sparkSession

    def entities(rows: DataFrame, key: str, tag: str) -> DataFrame:
        parts = F.array_join(F.sort_array(F.collect_list(F.concat("feature", F.lit(":"), F.col("value").cast("string")))), "|")
        return rows.groupBy(key).agg(parts.alias("f")).select(F.concat(F.lit(f"{tag},"), F.col(key).cast("string"), F.lit(","), "f").alias("value"))

    first = spark.createDataFrame([(f"R,{lowest},{highest}",)], "value string")
    rated = ratings.select(F.concat_ws(",", F.col("user").cast("string"), F.col("item").cast("string"), F.col("rating").cast("string")).alias("value"))
    first.unionByName(entities(user_features, "user", "U")).unionByName(entities(item_features, "item", "I")).unionByName(rated).write.mode("overwrite").text(path)
