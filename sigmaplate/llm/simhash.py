"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

Fingerprints that differ in at most 3 bits agree on one of 4 blocks of 16 bits (or on 2 of 5, 3 of
6 blocks for larger tables), so comparing within equal blocks loses no link.  Rows of a block value
are sorted by population count and compared in square tiles: numpy exclusive-or and bit counts,
skipping pairs of tiles whose population counts differ by more than the radius.  A block value with
many rows is cut into slices by population count and dealt over tasks as pairs of slices; a row goes
to those slices alone whose counts lie within the radius.  Each task reports a spanning star of what
it finds instead of all pairs, and connected components are resolved by alternating star steps on
tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, rows

RADIUS = 3
SHINGLE = 3
SEED = 42
TILE = 256
#: Rows of one block value that a task takes as one slice.
SLICE = 4096
_HASHES = 1 << 16
_HOT = 4096


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a whole text; zero without words.

    bytes.lower and bytes.split treat just A-Z and just U+0020, U+0009 to U+000D.
    """
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    n = max(1, len(words) - SHINGLE + 1)
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for lo in range(0, n, _HASHES):
        size = min(_HASHES, n - lo)
        h = np.fromiter((digest(next(shingles), SEED) for _ in range(size)), "<u8", size)
        total += np.unpackbits(h.view(np.uint8).reshape(size, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * total > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, fp) and ``more`` columns of longs of every row: the fingerprint as a signed long.  Null text has no words."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "fp", *more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t) for (t,) in rows(iter([batch]), "text", at_once=256)]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp, *[batch.column(2 + k) for k in range(len(more))]], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more).mapInArrow(run, ", ".join(f"{c} long" for c in schema.names))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star (node, least node) of each component of the edges a-b."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        differ = rx != ry
        if not differ.any():
            break
        x, y, rx, ry = x[differ], y[differ], rx[differ], ry[differ]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (jumped := root[root]).tobytes() != root.tobytes():
            root = jumped
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _within(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints of one slice pair, reduced to stars tile by tile."""
    counts = np.bitwise_count(fp)
    order = np.argsort(counts, kind="stable")
    fp, counts = fp[order], counts[order].astype(np.int64)
    found_a, found_b = [fp[:0]], [fp[:0]]
    root = np.arange(len(fp))
    for i in range(0, len(fp), TILE):
        one = fp[i : i + TILE]
        top = counts[min(i + TILE, len(fp)) - 1]
        for j in range(i, len(fp), TILE):
            if counts[j] - top > radius:
                break  # tiles further on differ even more
            u, v = np.nonzero(np.bitwise_count(one[:, None] ^ fp[None, j : j + TILE]) <= radius)
            ru, rv = root[u + i], root[v + j]
            new = ru != rv
            if not new.any():
                continue
            a, b = stars(ru[new], rv[new])
            found_a.append(fp[a])
            found_b.append(fp[b])
            to = np.arange(len(fp))
            to[a] = b
            root = to[root]
    return np.concatenate(found_a), np.concatenate(found_b)


def _compare(radius: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    small = 32

    def links(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """group: start of each row's group; rows of a group stand together."""
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        sizes = np.diff(np.append(starts, len(fp)))
        a, b = [fp[:0]], [fp[:0]]
        for lo, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
            x, y = _within(fp[lo : lo + n], radius)
            a.append(x)
            b.append(y)
        rest = np.repeat(sizes <= small, sizes)
        g, f = group[rest], fp[rest]
        for d in range(1, int(sizes[sizes <= small].max(initial=1))):
            hit = (g[d:] == g[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= radius)
            a.append(f[d:][hit])
            b.append(f[:-d][hit])
        return stars(np.concatenate(a), np.concatenate(b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)

        def emit(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            changed = np.append(True, (k[1:] != k[:-1]).any(1)) if len(k) else np.zeros(0, bool)
            u, v = links(np.cumsum(changed), f)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=schema)

        for batch in batches:
            k = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)], 1)
            keys = np.concatenate([keys, k])
            fps = np.concatenate([fps, batch.column(4).to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            last = np.flatnonzero((keys != keys[-1]).any(1))  # the last group may go on in the next batch
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield from emit(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield from emit(keys, fps)

    return run


def links(distinct: DataFrame, radius: int = RADIUS, slice_rows: int = SLICE, blocks: int | None = None) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp, no repeats) that span the components.

    Any two fingerprints within the radius are connected by the result.  blocks: into how many the
    64 bits are cut; two fingerprints within the radius agree on ``blocks - radius`` of them, so
    more blocks make the shared values longer and the comparisons fewer; by default it follows the
    number of fingerprints.
    """
    if blocks is None:
        n = distinct.count()
        blocks = radius + 1 if n <= 1 << 24 else radius + 2 if n <= 1 << 31 else radius + 3
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    masks = [sum(((1 << int(hi - lo)) - 1) << int(lo) for lo, hi in zip(edges[:-1], edges[1:], strict=True) if lo in chosen) for chosen in combinations(edges[:-1].tolist(), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    table = F.array(*[F.struct(F.lit(k).alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for k, m in enumerate(signed)])
    keyed = distinct.select("fp", F.bit_count("fp").alias("ones"), F.explode(table).alias("key")).select("key.block", "key.value", "ones", "fp")
    # Block values with more rows than a slice; at most blocks * n / slice_rows of them, each a row for 65 population counts at most.
    block = Window.partitionBy("block", "value")
    near = block.orderBy("ones").rangeBetween(-radius, radius)
    crowded = keyed.groupBy("block", "value", "ones").agg(F.count("*").alias("n"))
    crowded = crowded.withColumn("before", F.sum("n").over(block.orderBy("ones")) - F.col("n")).withColumn("all", F.sum("n").over(block))
    crowded = crowded.withColumn("least", F.min("before").over(near)).withColumn("most", F.max(F.col("before") + F.col("n")).over(near))
    crowded = crowded.where(F.col("all") > slice_rows).drop("all")
    keyed = keyed.join(crowded, ["block", "value", "ones"], "left")
    place = F.col("before") + F.pmod(F.xxhash64("fp"), F.col("n"))
    part = lambda at: F.coalesce(F.floor(at / slice_rows), F.lit(0)).cast("int")
    keyed = keyed.withColumn("own", part(place)).withColumn("other", F.explode(F.sequence(part(F.col("least")), part(F.col("most") - 1))))
    keyed = keyed.select("block", "value", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    where = ["block", "value", "a", "b"]
    dealt = keyed.repartition(*where).sortWithinPartitions(*where)
    return dealt.mapInArrow(_compare(radius), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component for every node of the edges (u, v).

    Alternates large-star and small-star steps until nothing changes.  A step takes each node's
    least neighbour by a pre-aggregated minimum and joins it back, so a node with very many
    neighbours is never gathered in one place; each round is a table in the shared folder.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges, seen = materialize(edges, "edges"), None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == seen or mark["n"] == 0:
            break
        seen = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = materialize(small.where("u <> v").distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _roots(distinct: DataFrame, radius: int) -> DataFrame:
    """(fp, root) of each of the distinct fingerprints that is linked to another."""
    tree = components(links(distinct, radius))
    return tree.unionByName(tree.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id of all rows whose fingerprints are reachable over links of
    at most ``radius`` differing bits; null only if all of them are null.  Null, empty and wordless
    texts have fingerprint zero and are linked like any other; repeated rows share a fingerprint;
    an empty table gives none.  Copies share a fingerprint and meet in a pre-aggregated minimum;
    only distinct fingerprints are compared.
    """
    own = materialize(fingerprints(docs), "fingerprints")
    first = own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    linked = materialize(_roots(first.select("fp"), radius).join(first.select("fp", "first"), "fp"), "linked")
    least = materialize(linked.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("n")), "least")
    linked = _named(linked, least, "root").select("fp", "least")
    named = first.join(linked, "fp", "left").select("fp", "n", F.coalesce("least", "first").alias("component_id"))
    named = materialize(named, "components")
    return _named(own, named, "fp").select("doc_id", "fp", "component_id")


def _named(members: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """members joined to names by key; names has each key once and n, its number of members, and is read several times.

    Keys of more than 1 in _HOT members, fewer than _HOT of them, go to the members instead of gathering those.
    """
    total = names.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") * _HOT > F.lit(total)
    hot = F.broadcast(names.where(is_hot).drop("n"))
    rest = members.join(hot.select(key), key, "left_anti").join(names.where(~is_hot).drop("n"), key)
    return members.join(hot, key).unionByName(rest)


def keep_representatives(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: that with the least doc_id, nulls last, and of equal ones the first.

    Rows are judged each, whatever ids they share: a doc_id on texts of two components stays in
    both.  Same cases as ``near_duplicates``.  Rows are numbered in a table of their own.
    """
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all")
    packed = materialize(docs.select(every, F.monotonically_increasing_id().alias("row")), "rows")
    own = fingerprints(packed.select(F.col("all.doc_id").alias("doc_id"), F.col("all.text").alias("text"), "row"), "row")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    first = materialize(own.groupBy("fp").agg(F.min(place).alias("first")), "firsts")
    named = first.join(_roots(first.select("fp"), radius), "fp", "left")
    stays = named.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first")).select("first.row")
    return packed.join(stays, "row", "left_semi").select(*[F.col(f"all.`{c}`").alias(c) for c in docs.columns])
