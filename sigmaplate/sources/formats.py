"""Text formats of learners' data: recommender sets, labelled features, ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _features(col):
    """index:value|index:value as (index, value) pairs."""
    parts = F.filter(F.split(col, r"\|"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, ":", 1).alias("feature"), F.substring_index(p, ":", -1).cast("double").alias("value")))


def read_recommender(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """ratings, users and items of a file with lines R,min,max; U,id,f:v|f:v; I,id,f:v; user,item,rating.

    Lines that start with # are comments.
    """
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    cells = lines.select(F.split("value", ",").alias("c"))
    tag = F.col("c")[0]

    def entities(which: str) -> DataFrame:
        of = cells.where((tag == which) & (F.size("c") >= 2))
        return of.select(F.col("c")[1].alias("id"), F.explode_outer(_features(F.coalesce(F.try_element_at("c", F.lit(3)), F.lit("")))).alias("f")).select("id", "f.feature", "f.value")

    rated = cells.where(~tag.isin("R", "U", "I") & (F.size("c") == 3))
    return {
        "ratings": rated.select(F.col("c")[0].alias("user"), F.col("c")[1].alias("item"), F.col("c")[2].cast("double").alias("rating")),
        "users": entities("U"),
        "items": entities("I"),
        "range": cells.where((tag == "R") & (F.size("c") == 3)).select(F.col("c")[1].cast("double").alias("least"), F.col("c")[2].cast("double").alias("most")),
    }


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """(label, features map) of lines "label feature:value ..." or dense "label value ..."."""
    cells = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("c"))
    rest = F.slice("c", F.lit(2), F.size("c") - 1)
    sparse = F.transform(rest, lambda p: F.struct(F.substring_index(p, ":", 1).alias("k"), F.substring_index(p, ":", -1).cast("double").alias("v")))
    dense = F.transform(rest, lambda p, i: F.struct(i.cast("string").alias("k"), p.cast("double").alias("v")))
    is_sparse = F.exists(rest, lambda p: p.contains(":"))
    return cells.select(F.col("c")[0].alias("label"), F.map_from_entries(F.when(is_sparse, sparse).otherwise(dense)).alias("features"))


def write_ratings(data: DataFrame, path: str) -> None:
    data.select("user", "item", "rating").write.csv(path)


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("user string, item string, rating double").csv(path)


def write_ranked(data: DataFrame, path: str, query: str, item: str, place: str) -> None:
    """A line for each query entity: its id and its list in order."""
    lists = data.groupBy(query).agg(F.sort_array(F.collect_list(F.struct(place, item))).alias("l"))
    line = F.concat_ws(",", F.col(query).cast("string"), F.transform("l", lambda e: e[item].cast("string")))
    lists.select(line.alias("value")).write.text(path)
