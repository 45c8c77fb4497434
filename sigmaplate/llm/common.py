"""Shared plumbing of the training-data operators: shared scratch tables and Arrow helpers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Scratch folders of this process, for ``discard``.
_folders: list[str] = []
#: Bytes of Arrow columns that are turned into Python values, or gathered into one batch, at a time.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """A scratch folder that driver and executors share, below ``spark.checkpoint.dir``.

    Where that is unset, local mode takes a folder of the warehouse; a cluster raises, as a path
    there could lie on each machine's own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    _folders.append(f"{root.rstrip('/')}/sigmaplate-{uuid.uuid4().hex}")
    return _folders[-1]


def discard(spark: SparkSession) -> None:
    """Delete the scratch folders that this process made; results that read them must be written before."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(_folders.pop())
        path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table of the shared folder and read it back.

    This cuts the lineage with replicated or shared files, so a lost executor costs at most a
    reread, and it keeps the work above from being run once for every reader.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z alone, whatever the locale."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(batches: Iterator[pa.RecordBatch], *columns: str, at_once: int = 1024) -> Iterator[tuple]:
    """Python tuples of the columns, converting at most ``at_once`` rows and about BATCH_BYTES at a time."""
    for batch in batches:
        arrays = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        size = sum(a.nbytes for a in arrays)
        step = max(1, min(at_once, batch.num_rows * BATCH_BYTES // max(1, size)))
        for lo in range(0, batch.num_rows, step):
            yield from zip(*(a.slice(lo, step).to_pylist() for a in arrays), strict=True)


def _size(row: tuple) -> int:
    return sum(len(v) for v in row if isinstance(v, (bytes, str, list)))


def record_batches(source: Iterator[tuple], schema: pa.Schema, at_once: int = 4096) -> Iterator[pa.RecordBatch]:
    """Arrow batches of Python tuples, of at most ``at_once`` rows and, but for its last row, BATCH_BYTES of values."""
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        columns = list(zip(*held, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
        )

    for row in source:
        held.append(row)
        size += _size(row)
        if len(held) >= at_once or size >= BATCH_BYTES:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def release() -> None:
    """Give back to the system what this process's allocators hold but don't use: Python workers live on over many tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for a document whose crc32 of the id as text is 2 modulo 4; false for a null id."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(crc % 4 == 2, F.lit(False))


def learnable(doc_id: str = "doc_id") -> Column:
    """True for a document that may be learned from: a non-null id that isn't held out."""
    return F.col(doc_id).isNotNull() & ~held_out(doc_id)
