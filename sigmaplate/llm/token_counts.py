"""Token counts: huge documents in overlapping chunks, spliced at proven common boundaries.

A document is encoded in chunks that overlap, each with the offsets of its pieces of ids.  Two
neighbours are spliced at a place of their overlap where both have a boundary and where a space
follows a character that isn't white space: no pre-token crosses such a place whatever surrounds it
(see ``bpe``), so the left chunk's ids up to it and the right chunk's ids from it are those of the
whole text.  If an overlap has no such place, it is doubled; once it is the whole left chunk, that
doubles instead.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import record_batches, rows

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def splice(text: str, parts: Callable[[str], tuple[list[bytes], list[int]]], chunk: int, overlap: int) -> Iterator[bytes]:
    """Ids of ``text``, in order, from overlapping chunks; ``parts`` encodes one, see ``bpe.ByteBpe.parts``."""
    start, end = 0, min(len(text), chunk)  # the open chunk
    done = 0  # the character up to which ids are out; a break of the open chunk, or 0
    ids, starts = parts(text[start:end])
    while end < len(text):
        width = overlap
        while True:
            lo = max(start, end - width)
            hi = min(len(text), lo + max(chunk, 2 * width))
            right = parts(text[lo:hi])
            first = bisect_right(starts, max(lo, done) - start)
            ours = {start + p: k for k, p in enumerate(starts[first:], first)}
            common = []
            for k, p in enumerate(right[1]):
                if lo + p >= end:
                    break
                if k and lo + p in ours and text[lo + p] == " " and not text[lo + p - 1].isspace():
                    common.append(lo + p)
            if common:
                cut = common[len(common) // 2]
                yield b"".join(ids[bisect_left(starts, done - start) : ours[cut]])
                start, end, done, (ids, starts) = lo, hi, cut, right
                break
            if lo == start:  # the overlap is the whole open chunk: that grows instead
                end = min(len(text), 2 * end - start)
                ids, starts = parts(text[start:end])
                break
            width *= 2
    yield b"".join(ids[bisect_left(starts, done - start) :])


def counter(path: str, chunk: int = 4096, overlap: int = 256) -> Callable[[str], int]:
    """The number of ids of a text, for a ``.json`` or ``.model`` file.

    .json: ``tokenizers`` without special tokens; .model: ``sentencepiece``, whose normalisation
    looks at whole texts, so that those are encoded whole, as are texts under .json files without
    proven breaks.
    """
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    coder = bpe.encoder(path)
    if not coder.splits:
        return lambda text: len(coder.library([text])[0]) // 4

    def count(text: str) -> int:
        whole = len(text) <= chunk or not coder.plain_specials and any(s in text for s in coder.specials)
        return sum(map(len, splice(text, coder.parts, len(text) if whole else chunk, overlap))) // 4

    return count


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, chunk: int = 4096, overlap: int = 256) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs (doc_id, text).

    Null text is empty and has no ids; repeated rows are counted each; other columns are ignored;
    an empty table gives no rows.  No shuffle: a document's figures depend on it alone.  chunk and
    overlap are numbers of characters; a shorter text is one chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer, chunk, overlap)
        texts = ((d, t or "") for d, t in rows(batches, "doc_id", "text", at_once=256))
        source = ((d, len(t.encode()), count(t)) for d, t in texts)
        yield from record_batches(source, _SCHEMA)

    counted = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
