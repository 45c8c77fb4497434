"""Distributions over strings with finite support, and weighted automata over characters."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def support(data: DataFrame, key: str, value: str) -> DataFrame:
    """The empirical distribution of a string column under each key: (key, value, logp)."""
    counts = data.groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.select(key, value, F.log(F.col("n") / F.sum("n").over(Window.partitionBy(key))).alias("logp"))


def product(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """The normalised product of two distributions (value, logp): the intersection of supports."""
    both = a.select(value, F.col("logp").alias("x")).join(b.select(value, F.col("logp").alias("y")), value)
    both = both.select(value, (F.col("x") + F.col("y")).alias("logp"))
    shifted = both.join(F.broadcast(both.agg(F.max("logp").alias("top"))))  # one row
    total = shifted.agg((F.first("top") + F.log(F.sum(F.exp(F.col("logp") - F.col("top"))))).alias("z"))  # one row
    return both.join(F.broadcast(total)).select(value, (F.col("logp") - F.col("z")).alias("logp"))


def character_bigrams(data: DataFrame, text: str) -> DataFrame:
    """Transition probabilities between the first characters of words: a Markov model of strings."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(F.col(text), i, F.lit(2)))
    c = data.where(F.length(text) > 1).select(F.explode(pairs).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    c = c.select(F.substring("p", 1, 1).alias("first"), F.substring("p", 2, 1).alias("second"), "n")
    return c.select("first", "second", "n", (F.col("n") / F.sum("n").over(Window.partitionBy("first"))).alias("p"))


def concatenated(a: DataFrame, first: str, b: DataFrame, second: str, between: str = "") -> DataFrame:
    """(value, logp) of two independent strings one after the other: all pairs of two finite supports; equal results add up."""
    both = a.select(F.col(first).alias("x"), F.col("logp").alias("p")).crossJoin(b.select(F.col(second).alias("y"), F.col("logp").alias("q")))
    each = both.select(F.concat("x", F.lit(between), "y").alias("value"), (F.col("p") + F.col("q")).alias("l"))
    return each.groupBy("value").agg(F.log(F.sum(F.exp("l"))).alias("logp"))


def mixed(parts: list[tuple[float, DataFrame]], value: str) -> DataFrame:
    """The weighted sum of distributions (value, logp)."""
    out = None
    for w, p in parts:
        shifted = p.select(value, (F.col("logp") + math.log(w)).alias("l"))
        out = shifted if out is None else out.unionByName(shifted)
    top = out.groupBy(value).agg(F.max("l").alias("top"))
    return out.join(top, value).groupBy(value, "top").agg(F.sum(F.exp(F.col("l") - F.col("top"))).alias("s")).select(value, (F.col("top") + F.log("s")).alias("logp"))


def products(support: DataFrame, key: str, value: str) -> DataFrame:
    """(a, b, value, logp): the normalised products of the distributions of all pairs of keys a < b."""
    x, y = support.alias("x"), support.alias("y")
    both = x.join(y, (F.col(f"x.{value}") == F.col(f"y.{value}")) & (F.col(f"x.{key}") < F.col(f"y.{key}")))
    both = both.select(F.col(f"x.{key}").alias("a"), F.col(f"y.{key}").alias("b"), F.col(f"x.{value}").alias(value), (F.col("x.logp") + F.col("y.logp")).alias("l"))
    top = both.groupBy("a", "b").agg(F.max("l").alias("top"))
    total = both.join(top, ["a", "b"]).groupBy("a", "b", "top").agg(F.sum(F.exp(F.col("l") - F.col("top"))).alias("s"))
    return both.join(total, ["a", "b"]).select("a", "b", value, (F.col("l") - F.col("top") - F.log("s")).alias("logp"))


def formatted(pattern: str, arguments: list[Column]) -> Column:
    """A pattern with {0}, {1}, ... replaced by the arguments."""
    parts = re.split(r"\{(\d+)\}", pattern)
    return F.concat(*[arguments[int(p)] if k % 2 else F.lit(p) for k, p in enumerate(parts) if k % 2 or p])


def parsed(pattern: str, text: Column, kinds: list[str]) -> list[Column]:
    """The arguments that a pattern was formatted from, as text; kinds are their regular expressions, by number; empty if the text doesn't fit."""
    parts = re.split(r"\{(\d+)\}", pattern)
    order = [int(p) for p in parts[1::2]]
    regex = "^" + "".join(f"({kinds[int(p)]})" if k % 2 else re.escape(p).replace("\\ ", " ") for k, p in enumerate(parts)) + "$"
    return [F.regexp_extract(text, regex, order.index(k) + 1) for k in range(len(kinds))]


#: Regular expressions of the named sets of strings.
STRING_SETS = {
    "lower": "[a-z]*", "upper": "[A-Z]*", "letters": "[A-Za-z]+", "digits": "[0-9]+", "letters_or_digits": "[A-Za-z0-9]+",
    "word_chars": r"\w+", "whitespace": r"\s+", "capitalized": "[A-Z][a-z]+", "any": "(?s).*",
}


def matches(text: Column, name: str, shortest: int = 0, longest: int | None = None) -> Column:
    """Whether a text lies in a named set of strings, with bounds of its length."""
    inside = text.rlike(f"^(?:{STRING_SETS[name]})$") & (F.length(text) >= shortest)
    return inside if longest is None else inside & (F.length(text) <= longest)


def at_word_boundary(text: Column, start: Column, size: Column) -> Column:
    """Whether the ``size`` characters from place ``start`` (from 1) touch no word character on either side."""
    before, after = F.substring(text, start - 1, F.lit(1)), F.substring(text, start + size, F.lit(1))
    return ((start == 1) | ~before.rlike(r"\w")) & ((start + size > F.length(text)) | ~after.rlike(r"\w"))


def character_distribution(data: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, character, n, p): how often each character occurs in a text column."""
    each = data.select(*keys, F.explode(F.split(text, "")).alias("character")).where("character <> ''")
    counts = each.groupBy(*keys, "character").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("t"))
    both = counts.join(totals, keys) if keys else counts.join(F.broadcast(totals))  # one row
    return both.select(*keys, "character", "n", (F.col("n") / F.col("t")).alias("p"))
