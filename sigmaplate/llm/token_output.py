"""Token-id output: documents to rANS shards (see ``tokenfile``) and back."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, tokenfile
from .common import record_batches, release, rows, shared_dir

SHARD_SCHEMA = "part int, file string, shard long, first_doc long, last_doc long, n_docs long, n_tokens long, payload binary"
_SHARDS = pa.schema(
    [("part", pa.int32()), ("file", pa.string())]
    + [(c, pa.int64()) for c in ("shard", "first_doc", "last_doc", "n_docs", "n_tokens")]
    + [("payload", pa.binary())]
)
_DOCS = pa.schema(
    [("part", pa.int32()), ("file", pa.string()), ("shard", pa.int64()), ("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("local_start", "n_tokens", "ids_crc32")]
)


def _shards(tokenizer: str, end_id: int, shard_tokens: int, cache: int, by_file: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Shards of the rows of a task; by_file: of rows that follow one another in a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = bpe.encoder(tokenizer, cache), int(end_id).to_bytes(4, "little")
        part, shard, file, after = TaskContext.get().partitionId(), 0, "", None
        names: list[int | None] = []
        sizes: list[int] = []
        held: list[bytes] = []
        total = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            row = (part, file, shard, names[0], names[-1], len(names), total, tokenfile.encode(names, sizes, ids))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SHARDS, strict=True)], schema=_SHARDS)

        source = ((r[:-1], r[-1]) for r in rows(batches, *(("doc_id", "part", "file", "row") if by_file else ("doc_id",)), "text", at_once=256))
        for (doc_id, *place), _, ids in coder.each(source):
            if by_file and (place[1], place[2]) != (file, after):
                if names:
                    yield flush()
                    names, sizes, held, total = [], [], [], 0
                part, file, shard = place
            after = place[2] + 1 if by_file else None
            ids += end
            names.append(doc_id)
            sizes.append(len(ids) // 4)
            held.append(ids)
            total += sizes[-1]
            if total >= shard_tokens:
                yield flush()
                names, sizes, held, total, shard = [], [], [], 0, after if by_file else shard + 1
                release()
        if names:
            yield flush()
        names, sizes, held = [], [], []
        release()

    return run


def _by_file(docs: DataFrame) -> DataFrame:
    """docs' ids and texts with each row's place: the number in its file's name, the name, and the row's number in it.

    A table that isn't read from files counts as one file, in the order of its partitions.
    """
    try:
        placed = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        placed = docs.select("doc_id", "text", F.lit("").alias("file"), F.monotonically_increasing_id().alias("row"))
    part = F.coalesce(F.regexp_extract("file", r"^part-(\d{1,9})", 1).try_cast("int"), F.lit(0))
    return placed.select("doc_id", "text", part.alias("part"), "file", "row")


def write_shards(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_tokens: int = 1_000_000, cache: int = bpe.CACHE, by_file: bool = False
) -> None:
    """Write the ids of all documents as shards in ascending doc_id order (nulls first).

    docs: columns doc_id and text; others are ignored.  Null text is empty; every document gets
    ``end_id`` behind its ids; rows that share a doc_id stay separate documents, ordered by a hash
    of their text.  An empty table gives a file set without rows.  The documents are
    range-partitioned by doc_id and that hash, so order holds over partitions (column part), over
    the shards of one (column shard) and within a shard.  A shard ends with the document that brings
    it to ``shard_tokens``, which bounds what a task holds to that and one document.  Tasks write
    through Spark's committer: a repeated task replaces what a lost one left.  cache: the size of
    each worker's cache, see ``bpe.ByteBpe``.

    by_file: in the order of docs' files and of the rows in them instead, whatever the ids.  Files
    are ordered by the number that Spark's writer gave them; nothing is shuffled.
    """
    if by_file:
        ordered = _by_file(docs)
    else:
        tie = F.xxhash64("text")
        ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    shards = ordered.mapInArrow(_shards(tokenizer, end_id, shard_tokens, cache, by_file), SHARD_SCHEMA)
    shards.write.option("compression", "none").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe.drop_encoders()  # all shards are written

    def decoded() -> Iterator[tuple]:
        for part, file, shard, payload in rows(batches, "part", "file", "shard", "payload", at_once=1):
            for doc_id, start, ids in tokenfile.decode(payload).documents():
                yield part, file, shard, doc_id, start, len(ids), zlib.crc32(ids.tobytes())

    yield from record_batches(decoded(), _DOCS)
    release()


def read_shards(table: DataFrame) -> DataFrame:
    """Decode a shard table into (doc_id, start, n_tokens, ids_crc32), one row per document.

    start counts the ids of all documents before it: the ids of earlier partitions or files and of
    earlier shards, summed from the shards' own counts, and the ids before it in its shard.
    """
    sizes = table.select("part", "file", "shard", "n_tokens")
    parts = sizes.groupBy("part", "file").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition of the writer, or file
    parts = parts.select("part", "file", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("part_start"))
    before = Window.partitionBy("part", "file").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "file", "shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("shard_start"))
    starts = starts.join(parts, ["part", "file"]).select("part", "file", "shard", (F.col("part_start") + F.col("shard_start")).alias("base"))
    docs = table.select("part", "file", "shard", "payload").mapInArrow(
        _documents, "part int, file string, shard long, doc_id long, local_start long, n_tokens long, ids_crc32 long"
    )
    return docs.join(starts, ["part", "file", "shard"]).select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2, cache: int = bpe.CACHE, by_file: bool = False) -> DataFrame:
    """Write the documents' shards into the shared folder and return what they hold, read back."""
    path = f"{shared_dir(docs.sparkSession)}/token_ids"
    write_shards(docs, path, tokenizer, end_id, cache=cache, by_file=by_file)
    return read_shards(docs.sparkSession.read.schema(SHARD_SCHEMA).parquet(path))
