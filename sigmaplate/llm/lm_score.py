"""LM scoring by cross-entropy difference between two matched bigram models.

The documents named as target train one model, all others the background model.  Both share one
vocabulary, order and smoothing.  Words (runs of characters other than space and U+0009 to U+000D,
A-Z lower-cased) and bigrams are counted by 64-bit hashes; a word seen fewer than ``MIN_COUNT``
times in all documents is the unknown word.  A word's probability is

    P(w | h) = (c(h, w) + MU * P(w)) / (c(h) + MU),   P(w) = (c(w) + 1) / (N + words)

with counts over all documents of the model, less the scored document's own.  A document's score is
the mean over its words of the loss under the target model less that under the background model, in
nats; below zero it resembles the target more.

Counts cover all documents and every distinct word and bigram, in tables that grow with the input;
just totals come to the driver.  Documents are packed into groups of about ``GROUP`` words.  A group
sends each of its distinct words, then each of its distinct bigrams, once with its counts, cut into
slices by ranges of the hash.  There are as many slices as keep one at ``SLICE`` hashes.  The sums of
a slice over all groups come back in the order of each group's hashes, and the group scores its
documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, record_batches, rows

MIN_COUNT = 2
MU = 8.0
#: Words of a group of documents, and of one packed row of it; hashes of one slice, over all groups.
GROUP, PACK, SLICE = 1 << 20, 1 << 16, 1 << 21
#: Words that a document counts as besides its own, so that a group has not too many documents.
_EACH = 8
#: Target ids that are sent to the workers as a sorted array (8 bytes each); more are joined.
MAX_IDS = 4_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[0, 9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)
#: What stands for the start of a text and for an unknown word among the words' hashes.
_START, _UNKNOWN = np.uint64(1), np.uint64(2)
_PACKS = pa.schema([("g", pa.int64()), ("at", pa.int32()), ("doc_id", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("mine", pa.list_(pa.bool_())), ("size", pa.int64()), ("data", pa.binary())])
_PACKS_DDL = "g long, at int, doc_id array<long>, n array<int>, mine array<boolean>, size long, data binary"
_SLICES = pa.schema([("g", pa.int64()), ("slice", pa.int64()), ("size", pa.int64()), ("data", pa.binary())])
_SLICES_DDL = "g long, slice long, size long, data binary"



def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def hash_words(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of a text, in order, computed over all of its bytes at once."""
    global _powers
    data = (text or "").encode().lower()
    b = np.frombuffer(data, np.uint8)
    space = _SPACE[b] & (b > 0)
    start = ~space
    start[1:] &= space[:-1]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64)
    ends = np.append(starts[1:], len(b))
    inside = np.arange(len(b)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(b)]])))
    longest = int((ends - starts).max())
    if longest > len(_powers):
        more = np.full(2 * longest, _STEP, np.uint64)
        more[0] = 1
        _powers = np.cumprod(more)
    values = (b.astype(np.uint64) + np.uint64(1)) * _powers[np.minimum(inside, longest - 1)]
    values[space] = 0
    return _mix(np.add.reduceat(values, starts))


def _pairs(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word and the one before it; ``first`` are the places of texts' first words."""
    before = np.append(_START, words[:-1])[: len(words)]
    before[first] = _START
    return _mix(before * _STEP + words)


def _marked(docs: DataFrame, target: DataFrame) -> tuple[DataFrame, Callable[[int | None, int | None], bool]]:
    """docs with a column mark, and a function of doc_id and mark: does the row train the target?"""
    ids = target.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ids = materialize(ids, "target_ids")
    spark = docs.sparkSession
    if ids.count() <= MAX_IDS:
        array = np.sort(np.array([r[0] for r in ids.collect()], np.int64))
        shared = spark.sparkContext.broadcast(array)

        def is_target(doc_id: int | None, mark: int | None) -> bool:
            a = shared.value
            k = int(np.searchsorted(a, doc_id)) if doc_id is not None and len(a) else len(a)
            return k < len(a) and a[k] == doc_id

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).alias("mark")), is_target
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids.withColumn("hit", F.lit(1)), "doc_id", "left")
    joined = materialize(joined.select("doc_id", "text", F.coalesce("hit", F.lit(0)).alias("mark")), "marked")
    return joined, lambda doc_id, mark: mark == 1


def _squeezed(*columns: np.ndarray) -> bytes:
    """Arrays of one length, compressed byte by byte of their 64-bit numbers."""
    planes = np.stack([c.astype("<u8") for c in columns]).view(np.uint8).reshape(len(columns), -1, 8)
    return pa.compress(np.ascontiguousarray(planes.transpose(0, 2, 1)).tobytes(), "zstd", asbytes=True)


def _spread(data: bytes, size: int, columns: int) -> np.ndarray:
    raw = pa.decompress(data, decompressed_size=8 * size * columns, codec="zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(columns, 8, size)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u8").reshape(columns, size)


def _gaps(keys: np.ndarray) -> np.ndarray:
    """Differences of sorted hashes; np.cumsum undoes it."""
    return np.diff(keys, prepend=np.uint64(0))


def _counted(places: np.ndarray, target: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.bincount(places[target], minlength=size), np.bincount(places[~target], minlength=size)


def _pack(marked: DataFrame, is_target) -> DataFrame:
    """Groups of documents: rows of documents with their words as places among the group's distinct words, and one of those words' hashes and counts (at -1)."""

    def packed(g: int, docs: list[tuple[int | None, bool, np.ndarray]]) -> Iterator[tuple]:
        keys, places = np.unique(np.concatenate([h for _, _, h in docs]), return_inverse=True)
        mine = np.repeat([m for _, m, _ in docs], [len(h) for _, _, h in docs])
        yield g, -1, [], [], [], len(keys), _squeezed(_gaps(keys), *_counted(places, mine, len(keys)))
        lo = at = held = 0
        for k, (_, _, h) in enumerate(docs):
            held += len(h)
            if held + _EACH * (k + 1 - lo) >= PACK or k + 1 == len(docs):
                some = docs[lo : k + 1]
                yield g, lo, [d for d, _, _ in some], [len(x) for _, _, x in some], [m for _, m, _ in some], held, _squeezed(places[at : at + held])
                lo, at, held = k + 1, at + held, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = TaskContext.get().partitionId() << 32
        docs, size = [], 0
        for doc_id, mark, text in rows(batches, "doc_id", "mark", "text", at_once=256):
            h = hash_words(text)
            docs.append((doc_id, bool(is_target(doc_id, mark)), h))
            size += len(h) + _EACH
            if size >= GROUP:
                yield from record_batches(packed(g, docs), _PACKS, 8)
                g, docs, size = g + 1, [], 0
        if docs:
            yield from record_batches(packed(g, docs), _PACKS, 8)

    return marked.mapInArrow(run, _PACKS_DDL)


class _Group:
    """The documents of one group, from its packed rows and its words' sums in any order."""

    def __init__(self, packs: pa.Table, sums: pa.Table) -> None:
        words, *docs = packs.sort_by("at").to_pylist()
        self.g = words["g"]
        self.doc_id = [d for r in docs for d in r["doc_id"]]
        self.n = np.array([n for r in docs for n in r["n"]], np.int64)
        self.mine = np.array([m for r in docs for m in r["mine"]], bool)
        self.ends = np.cumsum(self.n)
        words_of = np.concatenate([_spread(r["data"], r["size"], 1)[0] for r in docs]).astype(np.int64)
        self.counts = _returned(sums)  # of target and background, for each distinct word
        known = self.counts.sum(0) >= MIN_COUNT
        #: Each word's place among the distinct words; the unknown word is behind the last.
        self.words = np.where(known[words_of], words_of, len(known))
        hashes = np.append(np.cumsum(_spread(words["data"], words["size"], 3)[0], dtype=np.uint64), _UNKNOWN)
        first = (self.ends - self.n)[self.n > 0]
        #: The distinct bigrams' hashes, and each word's place among them.
        self.pair_keys, self.pairs = np.unique(_pairs(hashes[self.words], first), return_inverse=True)


def _cut(g: int, keys: np.ndarray, t: np.ndarray, b: np.ndarray, bits: int) -> Iterator[tuple]:
    """Rows of the slices of a group's sorted hashes and counts."""
    slices = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    starts = np.flatnonzero(np.diff(slices, prepend=-1))
    for lo, hi in zip(starts.tolist(), np.append(starts[1:], len(keys)).tolist(), strict=True):
        yield g, int(slices[lo]), hi - lo, _squeezed(_gaps(keys[lo:hi]), t[lo:hi], b[lo:hi])


def _returned(sums: pa.Table) -> np.ndarray:
    """[2, hashes] sums of target and background in the order of a group's hashes."""
    parts = sums.select(["slice", "size", "data"]).sort_by("slice").to_pylist()
    return np.concatenate([np.zeros((2, 0), np.int64), *[_spread(r["data"], r["size"], 2).astype(np.int64) for r in parts]], 1)


def _slice_sums(shares: pa.Table) -> pa.Table:
    """The sums of a slice for each of its groups, and a row (g -1) of what its distinct hashes add up to."""
    names = shares.select(["g", "slice", "size"]).to_pylist()
    parts = [_spread(d.as_py(), r["size"], 3) for d, r in zip(shares.column("data"), names, strict=True)]
    keys, places = np.unique(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), return_inverse=True)
    # Sums as doubles are exact up to 2^53.
    sums = np.stack([np.bincount(places, np.concatenate([p[k] for p in parts]).astype(np.float64), len(keys)) for k in (1, 2)]).astype(np.int64)
    seen = sums.sum(0) >= MIN_COUNT
    ends = np.cumsum([r["size"] for r in names]).tolist()
    out = [(r["g"], r["slice"], r["size"], _squeezed(*sums[:, places[end - r["size"] : end]])) for r, end in zip(names, ends, strict=True)]
    stated = np.array([*sums.sum(1), *sums[:, ~seen].sum(1), seen.sum()], "<i8")
    out.append((-1, names[0]["slice"], len(stated), stated.tobytes()))
    return pa.table([pa.array([r[c] for r in out], f.type) for c, f in enumerate(_SLICES)], schema=_SLICES)


def cross_entropy_difference(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_words, target_loss, background_loss, score, is_target) of every row of docs.

    docs: doc_id, text; target: doc_id of the documents that train the target model (nulls and
    repeats don't matter); other columns are ignored.  Losses are means in nats; a null or wordless
    text has 0 for all.  Repeated rows count and are scored each; with no target, or all, one of the
    models is uniform over the vocabulary; an empty table gives none.
    """
    marked, is_target = _marked(docs, target)
    packs = materialize(_pack(marked, is_target), "packs")
    size = packs.where("at >= 0").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bits = max(0, (-(-size // SLICE) - 1).bit_length())

    def word_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((g, *_spread(data, n, 3)) for g, n, data in rows(batches, "g", "size", "data", at_once=1))
        yield from record_batches((r for g, gaps, t, b in found for r in _cut(g, np.cumsum(gaps, dtype=np.uint64), t, b, bits)), _SLICES, 64)

    def pair_slices(documents: pa.Table, words: pa.Table) -> pa.Table:
        group = _Group(documents, words)
        cut = list(_cut(group.g, group.pair_keys, *_counted(group.pairs, np.repeat(group.mine, group.n), len(group.pair_keys)), bits))
        return pa.table([pa.array([r[c] for r in cut], f.type) for c, f in enumerate(_SLICES)], schema=_SLICES)

    words = packs.where("at = -1").mapInArrow(word_slices, _SLICES_DDL)
    words = materialize(words.groupBy("slice").applyInArrow(_slice_sums, _SLICES_DDL), "words")
    totals, unknown, vocabulary = [0, 0], [0, 0], 1
    for (stated,) in words.where("g = -1").select("data").toLocalIterator():  # a row for each slice
        x = np.frombuffer(stated, "<i8").tolist()
        totals, unknown, vocabulary = [totals[0] + x[0], totals[1] + x[1]], [unknown[0] + x[2], unknown[1] + x[3]], vocabulary + x[4]
    words = words.where("g <> -1")
    pairs = packs.groupBy("g").cogroup(words.groupBy("g")).applyInArrow(pair_slices, _SLICES_DDL)
    pairs = pairs.groupBy("slice").applyInArrow(_slice_sums, _SLICES_DDL).where("g <> -1")
    counted = words.withColumn("pair", F.lit(False)).unionByName(pairs.withColumn("pair", F.lit(True)))
    names = ["doc_id", "n_words", "target_loss", "background_loss", "score", "is_target"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def losses(w: np.ndarray, p: np.ndarray, words: np.ndarray, pairs: np.ndarray, mine: int) -> tuple[float, float]:
        if not len(w):
            return 0.0, 0.0
        out = []
        own_w, own_p = _repeats(w), _repeats(p)
        for k in (0, 1):
            cw, cp, total = words[k, w], pairs[k, p], float(totals[k])
            if k == mine:
                cw, cp, total = cw - own_w, cp - own_p, total - len(w)
            # The context of a word is the word before it; the start mark is seen by every text.
            context = np.append(0.0, cw[:-1])
            context[0] = cp[0]
            base = (np.maximum(cw, 0) + 1.0) / (max(total, 0.0) + vocabulary)
            out.append(float(-np.log((np.maximum(np.minimum(cp, context), 0) + MU * base) / (np.maximum(context, 0) + MU)).mean()))
        return out[0], out[1]

    def score(documents: pa.Table, counted: pa.Table) -> pa.Table:
        is_pair = counted.column("pair")
        group = _Group(documents, counted.filter(pc.invert(is_pair)))
        words = np.hstack([group.counts, np.array(unknown)[:, None]]).astype(np.float64)
        pairs = _returned(counted.filter(is_pair)).astype(np.float64)
        w, p = group.words, group.pairs
        out = []
        for doc_id, n, end, mine in zip(group.doc_id, group.n.tolist(), group.ends.tolist(), group.mine.tolist(), strict=True):
            x, y = losses(w[end - n : end], p[end - n : end], words, pairs, 0 if mine else 1)
            out.append((doc_id, n, x, y, x - y, mine))
        return pa.table([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], schema=schema)

    ddl = "doc_id long, n_words long, target_loss double, background_loss double, score double, is_target boolean"
    return packs.groupBy("g").cogroup(counted.groupBy("g")).applyInArrow(score, ddl)


def _repeats(slots: np.ndarray) -> np.ndarray:
    """How often each one's slot occurs among all of them."""
    _, index, counts = np.unique(slots, return_inverse=True, return_counts=True)
    return counts[index]
