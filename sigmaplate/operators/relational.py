"""Relational preparation of recommender and session data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..learners.classifier import numbered


def most_active(data: DataFrame, key: str, top: int) -> DataFrame:
    """The keys with most rows, ties by key: a top-k of pre-aggregated counts."""
    return data.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(top)


def having_all(data: DataFrame, key: str, value: str, values: list) -> DataFrame:
    """Keys that have every one of the values."""
    of = data.where(F.col(value).isin(values)).groupBy(key).agg(F.count_distinct(value).alias("k"))
    return of.where(F.col("k") == len(values)).select(key)


def unpivoted(data: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """(ids, feature, value): a row for each column, as text."""
    return data.select(*ids, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(ids, columns, "feature", "value")


def sessions(events: DataFrame, key: str, ts: str, tie: str, gap_seconds: int) -> DataFrame:
    """events with session, counted from 0 for each key: rows between gaps longer than the limit.

    The interval join "rows between a start row and the next start row" as a running sum of starts.
    """
    w = Window.partitionBy(key).orderBy(ts, tie)
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    start = (seconds - F.lag(seconds).over(w) > gap_seconds).cast("int")
    return events.withColumn("session", F.sum(F.coalesce(start, F.lit(0))).over(w))


def next_reply(turns: DataFrame) -> DataFrame:
    """To each user turn the turns up to the next one of the user: lead() gives the interval's end."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    asks = turns.where(F.col("role") == "user").select("conv_id", F.col("turn").alias("ask"), F.lead("turn").over(w).alias("until"))
    a, t = asks.alias("a"), turns.alias("t")
    between = (F.col("a.conv_id") == F.col("t.conv_id")) & (F.col("t.turn") > F.col("ask")) & (F.col("until").isNull() | (F.col("t.turn") < F.col("until")))
    return a.join(t, between).groupBy("a.conv_id", "ask").agg(F.count("*").alias("replies"), F.sum(F.length("t.text")).alias("chars"))


def updated(data: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """UPDATE ... FROM: the column of changes where the key has one."""
    new = changes.select(key, F.col(column).alias("_new"))
    return data.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def rescaled(column: Column) -> Column:
    """A rating in -10..10 as 1..10."""
    return F.ceil((column + 10.0) / 2.0).cast("int")


def hash_sample(data: DataFrame, key: Column, n: int) -> DataFrame:
    """n rows in a reproducible random order."""
    place = F.pmod(key * 2654435761, F.lit(4294967296))
    return data.withColumn("_place", place).orderBy("_place", key).limit(n).drop("_place")


def intersection(tables: list[DataFrame]) -> DataFrame:
    """Distinct rows that all tables have."""
    out = tables[0]
    for t in tables[1:]:
        out = out.intersect(t)
    return out.distinct()


def merged(tables: list[DataFrame], order: list[str]) -> DataFrame:
    """All rows of tables, sorted in ranges."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.repartitionByRange(*order).sortWithinPartitions(*order)


def cartesian(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs of rows; the result has the product of both sizes, so both should be small."""
    return a.crossJoin(b)


def indexed(data: DataFrame, key: str) -> DataFrame:
    """(key, index): a number from 0 for each distinct key, in its order."""
    return numbered(data.select(key).distinct(), [key], "index")


def union_of(tables: list[DataFrame], distinct: bool = False) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.distinct() if distinct else out


def folded(data: DataFrame, key: str, order: list[str], value: str, start: Column, step) -> DataFrame:
    """(key, result): a fold over a key's values in an order; the list of a key must fit a task, as a fold is sequential."""
    rows = data.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, value))).alias("rows"))
    return rows.select(key, F.aggregate("rows", start, lambda s, r: step(s, r[value])).alias("result"))


def all_reduced(data: DataFrame, keys: list[str], **sums: Column) -> DataFrame:
    """Every row with the sums of its key: partial sums, one exchange, and a join back."""
    totals = data.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return data.join(totals, keys) if keys else data.join(F.broadcast(totals))  # one row


def scattered(data: DataFrame, keys: list[str], partitions: int) -> DataFrame:
    """Rows dealt over partitions by key."""
    return data.repartition(partitions, *keys)
