"""Matrices as keyed rows, and small dense kernels in grouped Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of (i, j, v) matrices: a join on the inner index and a grouped sum."""
    x, y = a.alias("a"), b.alias("b")
    return x.join(y, F.col("a.j") == F.col("b.i")).groupBy(F.col("a.i").alias("i"), F.col("b.j").alias("j")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("v"))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def squared_exponential(a: Column, b: Column, log_length: float = 0.0, log_scale: float = 0.0) -> Column:
    """The kernel exp(2 log_scale) * exp(-d**2 / (2 exp(2 log_length)))."""
    return F.exp(F.lit(2 * log_scale) - (a - b) * (a - b) / (2 * float(np.exp(2 * log_length))))


def gaussian_process(data: DataFrame, key: str, x: str, y: str, at: list[float], noise: float, log_length: float = 0.0) -> DataFrame:
    """Posterior mean and variance at fixed inputs for each key; a key's rows are one dense system.

    Rows are averaged per distinct x first, with their counts as weights, which keeps the system
    the size of the distinct inputs.
    """
    points = data.groupBy(key, F.col(x).cast("double").alias("x")).agg(F.avg(F.col(y)).alias("y"), F.count("*").alias("n"))
    length = float(np.exp(log_length))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("x")
        xs, t = frame["x"].to_numpy(), np.array(at)
        kernel = lambda a, b: np.exp(-((a[:, None] - b[None, :]) ** 2) / (2 * length**2))
        k = kernel(xs, xs) + np.diag(noise / frame["n"].to_numpy())
        cross = kernel(t, xs)
        solved = np.linalg.solve(k, np.column_stack([frame["y"].to_numpy(), cross.T]))
        variance = 1.0 - np.einsum("ij,ji->i", cross, solved[:, 1:])
        return pd.DataFrame({key: frame[key].iloc[0], "at": t, "mean": cross @ solved[:, 0], "variance": variance})

    kind = dict(data.dtypes)[key]
    return points.groupBy(key).applyInPandas(solve, f"`{key}` {kind}, at double, mean double, variance double")


def dense(vectors: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, present) of an array of lists: null and missing elements are 0 and not present."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    row = np.repeat(np.arange(len(sizes)), sizes)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    real = ~flat.is_null().to_numpy(zero_copy_only=False)
    values, present = np.zeros((len(sizes), dimensions)), np.zeros((len(sizes), dimensions))
    values[row[real], col[real]] = flat.drop_null().to_numpy(zero_copy_only=False)
    present[row[real], col[real]] = 1.0
    return values, present


def width(data: DataFrame, vector: str) -> int:
    """The largest number of elements of a vector."""
    return max(0, data.agg(F.coalesce(F.max(F.size(vector)), F.lit(0))).first()[0])


def gram(data: DataFrame, vector: str) -> DataFrame:
    """(i, j, v): the product of the transposed matrix, whose rows are the vectors, and itself, over all their elements.

    A task multiplies its rows in batches and sends its cells; null elements count as absent.
    """
    d = width(data, vector)
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, pairs = np.zeros((d, d)), np.zeros((d, d))
        for batch in batches:
            x, m = dense(batch.column(0), d)
            total += x.T @ x
            pairs += m.T @ m
        i, j = np.nonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], schema=schema)

    return data.select(vector).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def covariances(data: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, i, j, covariance): population covariances of all pairs i <= j of the vectors' elements, for each key.

    A task adds up each key's cells about the key's first vectors and sends count, means and summed
    products; these are joined about the means of all.  Rows where either element is null or missing
    don't count for a pair.
    """
    d = width(data, vector)
    i, j = (a.astype(np.int32) for a in np.triu_indices(d))
    kind = dict(data.dtypes)[key]
    cells = ["n", "x", "y", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def flush(key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            for value, (shift, *sums) in held.items():
                n, x, y, c = (s[i, j] for s in sums)
                some = n > 0
                n, x, y, c = n[some], x[some], y[some], c[some]
                columns = [n, x / n + shift[i[some]], y / n + shift[j[some]], c - x * y / n]
                yield pa.RecordBatch.from_arrays([pa.array([value] * len(n), key_type), pa.array(i[some]), pa.array(j[some]), *map(pa.array, columns)], names=[key, "i", "j", *cells])
            held.clear()

        key_type = pa.null()
        for batch in batches:
            key_type = batch.column(0).type
            values, present = dense(batch.column(1), d)
            where: dict = {}
            for at, value in enumerate(batch.column(0).to_pylist()):
                where.setdefault(value, []).append(at)
            for value, at in where.items():
                x, m = values[at], present[at]
                if value not in held:
                    if len(held) >= 256:
                        yield from flush(key_type)
                    held[value] = [x.sum(0) / np.maximum(m.sum(0), 1), *np.zeros((4, d, d))]
                shift, n, sx, sy, c = held[value]
                x = (x - shift) * m
                n += m.T @ m
                sx += x.T @ m
                sy += m.T @ x
                c += x.T @ x
        yield from flush(key_type)

    parts = data.select(key, vector).mapInArrow(run, f"`{key}` {kind}, i int, j int, " + ", ".join(f"{c} double" for c in cells))
    all_parts = Window.partitionBy(key, "i", "j")
    mean = lambda c: F.sum(F.col("n") * F.col(c)).over(all_parts) / F.sum("n").over(all_parts)
    parts = parts.withColumn("mx", mean("x")).withColumn("my", mean("y"))
    parts = parts.withColumn("p", F.col("c") + F.col("n") * (F.col("x") - F.col("mx")) * (F.col("y") - F.col("my")))
    return parts.groupBy(key, "i", "j").agg((F.sum("p") / F.sum("n")).alias("covariance"))
