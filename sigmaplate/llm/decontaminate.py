"""Benchmark decontamination: one Aho-Corasick automaton over normalised test passages.

Texts are lower-cased (A-Z) and cut into words of digits, letters a-z and all characters beyond
ASCII.  A window is 13 consecutive words of a benchmark item, or the whole of a shorter one.  The
automaton's patterns are blocks of words, each word folded to one of 255 symbols: the 7 words from
each of an item's places 0, 7, 14, ..., and shorter items whole.  Every window of 13 holds such a
block, so a document's words run through the automaton once; a block that was found is compared
with the item word by word, and so are up to 6 words on either side.  13 or more in a row are
windows, all of them.  An item of n words costs about n nodes instead of the 13 n of its windows.
The places of hit words lead back to offsets in the original text.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, record_batches, rows

WINDOW = 13
#: Share of hit words, as 1 in so many, from which a document counts as contaminated.
SHARE = 20
#: Benchmark words of one automaton; README states the memory that a worker takes for it.
MAX_WORDS = 3_000_000
#: Words of an item that go into one row; longer items become overlapping rows.
SEGMENT = 100_000
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")
_BORDER, _UNKNOWN = -1, 0


def _symbol(number: int) -> str:
    return chr(number % 255 + 1)


def words(text: str | None) -> list[bytes]:
    """The normalised words of a text, in UTF-8; none of null."""
    return (text or "").encode().translate(_FOLD).split()


class Matcher:
    """Finds the benchmark windows in texts.

    items: (item_id, text).  Null and repeated ids: windows of a null id hit words but count as no
    item; rows that share an id are one item.
    """

    def __init__(self, items: Iterable[tuple[int | str | None, str | None]], window: int = WINDOW) -> None:
        import ahocorasick

        block = (window + 1) // 2
        self.reach = window - block
        self.ids: dict[bytes, int] = {}
        names: dict[int | str | None, int] = {}
        #: All items' words in a row, with borders that equal no word between them.
        self.sequence = array("i", repeat(_BORDER, self.reach))
        patterns: dict[str, int] = {}
        surroundings: dict[tuple[int, int, bytes], int] = {}
        #: To each pattern the groups of places with the same surroundings; of a group a place, the words it needs, its first item and others.
        self.groups: list[list[int]] = []
        self.places, self.needs, self.owner = array("q"), array("i"), array("i")
        self.others: dict[int, set[int]] = {}
        for item_id, text in items:
            numbers = array("i", (self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)))
            n = len(numbers)
            if not n:
                continue
            owner = names.setdefault(item_id, len(names))
            at = len(self.sequence)
            self.sequence.extend(numbers)
            self.sequence.extend(repeat(_BORDER, self.reach))
            folded = "".join(map(_symbol, numbers))
            size, need = (n, n) if n < window else (block, window)
            for k in range(0, n - size + 1, size):
                which = patterns.setdefault(folded[k : k + size], len(patterns))
                if which == len(self.groups):
                    self.groups.append([])
                place = at + k
                around = self.sequence[place - self.reach : place + size + self.reach].tobytes()
                group = surroundings.setdefault((which, need, around), len(self.places))
                if group == len(self.places):
                    self.groups[which].append(group)
                    self.places.append(place)
                    self.needs.append(need)
                    self.owner.append(owner)
                elif self.owner[group] != owner:
                    self.others.setdefault(group, set()).add(owner)
        self.names = list(names)
        self.symbols = {w: _symbol(k) for w, k in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for pattern, which in patterns.items():
            self.automaton.add_word(pattern, (which, len(pattern)))
        del surroundings
        if patterns:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, merged ranges [first, end) of hit words, ids of the items found."""
        w = words(text)
        if not w or not self.places:
            return len(w), [], set()
        matches = list(self.automaton.iter("".join(map(self.symbols.get, w, repeat("\0")))))
        if not matches:
            return len(w), [], set()
        numbers = array("i", map(self.ids.get, w, repeat(_UNKNOWN)))
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        sequence = self.sequence
        for last, (which, size) in matches:
            first, end = last + 1 - size, last + 1
            core, left, right = numbers[first:end], min(self.reach, first), min(self.reach, len(w) - end)
            for group in self.groups[which]:
                place = self.places[group]
                if sequence[place : place + size] != core:
                    continue
                a = b = 0
                while a < left and sequence[place - 1 - a] == numbers[first - 1 - a]:
                    a += 1
                while b < right and sequence[place + size + b] == numbers[end + b]:
                    b += 1
                if a + size + b >= self.needs[group]:
                    found.append((first - a, end + b))
                    items.add(self.owner[group])
                    items |= self.others.get(group, set())
        ranges: list[tuple[int, int]] = []
        for first, end in sorted(found):
            if ranges and first <= ranges[-1][1]:
                ranges[-1] = (ranges[-1][0], max(ranges[-1][1], end))
            else:
                ranges.append((first, end))
        return len(w), ranges, {self.names[i] for i in items}


def spans(text: str | None, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words as character offsets [start, end) of the original text."""
    if not ranges:
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    return [(places[a][0], places[b - 1][1]) for a, b in ranges]


_built: dict[str, Matcher] = {}


def _matcher(key: str, items, window: int) -> Matcher:
    """The process's automaton of a broadcast; Python workers live on over many tasks and hold one."""
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(items.value, window)
    return _built[key]


_FOUND = "doc_id long, row long, n_words long, spans array<struct<first: long, stop: long, start: long, end: long>>, items array<string>"
_FOUND_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64())]
    + [("spans", pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "stop", "start", "end")]))), ("items", pa.list_(pa.string()))]
)


def _scan(docs: DataFrame, shared, window: int) -> DataFrame:
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(key, shared, window)

        def scanned() -> Iterator[tuple]:
            for doc_id, row, text in rows(batches, "doc_id", "row", "text", at_once=256):
                n, ranges, found = matcher.scan(text)
                places = [{"first": a, "stop": b, "start": s, "end": e} for (a, b), (s, e) in zip(ranges, spans(text, ranges), strict=True)]
                yield doc_id, row, n, places, [str(i) for i in found if i is not None]

        yield from record_batches(scanned(), _FOUND_SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "row", "text").mapInArrow(run, _FOUND)


def _united(found: Column) -> Column:
    """Sorted spans without overlap from spans in any order; those that touch become one."""

    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(
            last["first"].alias("first"), F.greatest(last["stop"], s["stop"]).alias("stop"),
            last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"),
        )
        touches = (F.size(done) > 0) & (last["stop"] >= s["first"])
        return F.when(touches, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    none = F.array().cast("array<struct<first: bigint, stop: bigint, start: bigint, end: bigint>>")
    return F.aggregate(F.array_sort(found), none, add)


def _segments(benchmark: DataFrame, window: int, most: int) -> DataFrame:
    """(item, text, n): distinct rows of an item's normalised words, at most ``most`` each; long items overlap by window - 1."""
    schema = pa.schema([("item", pa.string()), ("text", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut() -> Iterator[tuple]:
            for item, text in rows(batches, "item", "text", at_once=64):
                w = words(text)
                step = max(most, window) - window + 1
                for lo in range(0, max(1, len(w) - window + 1) if w else 0, step):
                    some = w[lo : lo + step + window - 1]
                    yield item, b" ".join(some).decode(), len(some)

        yield from record_batches(cut(), schema)

    named = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return materialize(named.mapInArrow(run, "item string, text string, n long").dropDuplicates(["item", "text"]), "benchmark")


def _parts(benchmark: DataFrame, window: int, max_words: int) -> list:
    """Functions that each bring one part of the benchmark, of about max_words, to the driver."""
    segments = _segments(benchmark, window, min(SEGMENT, max_words))
    size = segments.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, -(-size // max_words))

    def part(k: int) -> list[tuple[str | None, str]]:
        of = segments if parts == 1 else segments.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        return [(r[0], r[1]) for r in of.select("item", "text").collect()]

    return [lambda k=k: part(k) for k in range(parts)]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, max_words: int = MAX_WORDS, row: str | None = None) -> DataFrame:
    """(doc_id, row, n_words, n_hit, n_items, items_sha256, contaminated, items, spans) of every row of docs.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored.  A word inside any
    occurrence of a window is hit; a document is contaminated if 1 in ``share`` of its words or
    more is.  spans are the runs of hit words, as numbers of words (first, stop) and as character
    offsets in the original text (start, end).  Null and empty texts have no words and aren't
    contaminated; repeated rows are judged each; an empty benchmark hits nothing, empty docs give no
    rows.

    The benchmark's words are counted first.  Up to ``max_words`` they are sent to the workers, one
    automaton a worker, and nothing is shuffled.  A larger benchmark is cut by hash into parts of
    about that size; docs is scanned for one part after the other, each part's findings are written
    and its broadcast is dropped, and then spans and items are united per row.  Rows are numbered
    for that, unless ``row`` names a column of longs that tells them apart; a column of docs that
    happens to be called row is ignored like any other.
    """
    context = docs.sparkSession.sparkContext
    parts = _parts(benchmark, window, max_words)
    if len(parts) == 1:
        united = _scan(docs.select("doc_id", "text", F.lit(0).cast("long").alias("row")), context.broadcast(parts[0]()), window)
    else:
        if row:
            numbered = docs.select("doc_id", "text", F.col(row).alias("row"))
        else:
            numbered = materialize(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "numbered")
        scans = None
        for k, part in enumerate(parts):
            shared = context.broadcast(part())
            scan = _scan(numbered, shared, window)
            scan = materialize(scan if k == 0 else scan.where(F.size("spans") > 0), "found")
            shared.destroy()
            scans = scan if scans is None else scans.unionByName(scan)
        united = scans.groupBy("row", "doc_id", "n_words").agg(
            _united(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
        )
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["first"])
    united = united.withColumn("items", F.array_sort("items")).withColumn("n_hit", hit)
    return united.select(
        "doc_id", "row", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "items", "spans",
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, max_words: int = MAX_WORDS) -> DataFrame:
    """docs without its contaminated rows; same rule, cases and handling of size as ``contamination``.

    With one automaton each batch is filtered where it is scanned.
    """
    parts = _parts(benchmark, window, max_words)
    if len(parts) > 1:
        packed = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"), F.monotonically_increasing_id().alias("row")), "rows")
        judged = contamination(packed.select("all.doc_id", "all.text", "row"), benchmark, window, share, max_words, row="row")
        kept = packed.join(judged.where("contaminated").select("row"), "row", "left_anti")
        return kept.select(*[F.col(f"all.`{c}`").alias(c) for c in docs.columns])
    shared, key = docs.sparkSession.sparkContext.broadcast(parts[0]()), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(key, shared, window)

        def keeps(text: str | None) -> bool:
            n, ranges, _ = matcher.scan(text)
            hit = sum(b - a for a, b in ranges)
            return not (hit and share * hit >= n)

        for batch in batches:
            mask = [keeps(text) for (text,) in rows(iter([batch]), "text", at_once=256)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
