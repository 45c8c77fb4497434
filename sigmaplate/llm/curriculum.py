"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1; here its share is ramped linearly from
``1 + ramp`` to ``1 - ramp`` times its mean.  The schedule's integral, scaled to the source's target,
is the source's cumulative token demand.  A source's stream repeats its documents in hash order, one
pass after another; a copy gets the training position at which the demand reaches its place in the
stream, the inverse of the integral.  Copies are range-sorted by position.

What the mix takes of a source is its whole stream some times over and, in a last pass, the rows up
to a cut in hash order.  The cut is found digit by digit in sums of words by hash range, so the
table is never sorted or gathered.  Copies and positions of a row then follow from its hash and its
source's row of the mixture table alone: texts move just once, to their place in training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Share of each source, by its place in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3.0
#: Sources up to whose number the mixture table, of 2 kB a source, is broadcast; a longer one is joined as Spark sees fit.
_BROADCAST = 20_000
#: Bits of a hash, of its first digit (a range of the stream) and of its first two digits.
_BITS, _RANGE, _SECOND = 52, 8, 24
_RANGES = 1 << _RANGE
_LAST = (1 << 63) - 1
#: Words of one partition of the mix.
_PARTITION = 32_000_000


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and U+0009 to U+000D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with number, from 0 in code point order, null last: sorted in ranges offset by the ranges' counts."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = materialize(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("place", place).join(starts, "part").withColumn("number", F.col("first") + F.col("place")).drop("part", "place", "first")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = MAX_EPOCHS) -> tuple[DataFrame, int, float]:
    """sources (source, source_size, any more) with number and target, the words to take; their number; the words of all targets.

    The total is shared by weight, none above cap times its size, and the excess reshared among the
    rest by weight until none is above: that is one level of words a weight, raised step by step;
    each step is one sum over the sources.  Sources without words get 0.  If all are capped (cap <
    1), the mix is smaller than the total.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    table = _numbered(sources).withColumn("weight", weight).persist()
    most = F.col("source_size") * float(cap)
    zero = F.lit(0.0)
    n, total, free = table.agg(F.count("*"), F.coalesce(F.sum("source_size"), zero).cast("double"), F.coalesce(F.sum("weight"), zero)).first()
    level, capped, taken = total / free if free else 0.0, 0, 0.0
    while free:
        above = F.lit(level) * F.col("weight") > most
        now, taken, free = table.agg(
            F.coalesce(F.sum(above.cast("long")), F.lit(0)), F.coalesce(F.sum(F.when(above, most)), zero), F.coalesce(F.sum(F.when(~above, F.col("weight"))), zero)
        ).first()
        if now == capped:
            break
        level, capped = (total - taken) / free if free else level, now
    share = F.lit(level) * F.col("weight")
    return table.withColumn("target", F.least(share, most)).drop("weight"), n, taken + level * free


def _keyed(docs: DataFrame, keep: tuple[str, ...], seed: int) -> DataFrame:
    """row, source, size, the row's hash h and v, which tells rows of one hash apart."""
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    h = F.xxhash64("doc_id", "text", F.lit(seed)).bitwiseAND((1 << _BITS) - 1)
    return docs.select(kept, F.col("source").alias("source"), word_count(F.col("text")).alias("size"), h.alias("h"), F.monotonically_increasing_id().alias("v"))


def _range(h: str = "h") -> Column:
    return F.shiftright(h, _BITS - _RANGE).cast("int")


class _Mix:
    """Plans the mix of one table; ``mixture`` is a row for each source."""

    def __init__(self, docs: DataFrame, weights: tuple[float, ...], cap: float, ramp: float, seed: int) -> None:
        self.narrow = materialize(_keyed(docs, ("doc_id",), seed), "sizes")
        ranges = self.narrow.groupBy("source", _range().alias("at")).agg(F.sum("size").alias("words"))
        words = F.map_from_entries(F.collect_list(F.struct("at", "words")))  # at most _RANGES entries
        sources = ranges.groupBy("source").agg(F.sum("words").alias("source_size"), words.alias("words"))
        starts = F.aggregate(
            F.sequence(F.lit(0), F.lit(_RANGES - 1)), F.array(F.lit(0).cast("long")),
            lambda done, k: F.concat(done, F.array(F.element_at(done, -1) + F.coalesce(F.try_element_at("words", k), F.lit(0).cast("long")))),
        )
        mixture, n, self.words = targets(sources.withColumn("starts", starts).drop("words"), weights, cap)
        self.small = F.broadcast if n <= _BROADCAST else (lambda table: table)
        size = F.col("source_size")
        mixture = mixture.withColumn("passes", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0))
        mixture = mixture.withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * size))
        mixture = mixture.withColumn("ramp", F.when(F.col("number") % 2 == 1, -ramp).otherwise(ramp))
        mixture = self._with(mixture, self._cuts(mixture))
        self.mixture = materialize(self._with(mixture, self._fixes(mixture, cap)), "mixture")

    def _with(self, mixture: DataFrame, more: DataFrame) -> DataFrame:
        new = [F.col(f"b.{c}") for c in more.columns if c != "source"]
        return mixture.alias("a").join(self.small(more).alias("b"), _same("a", "b"), "left").select("a.*", *new)

    def _crossing(self, edge: DataFrame, lead: Column, digit: Column) -> DataFrame:
        """For each source of edge (source, at, left) the next digit where the words of its rows whose leading digits are ``at`` pass ``left``.

        at is the new leading digits; left what is left before it; words and n are those of its rows.
        """
        rows = self.narrow.where("size > 0").withColumn("lead", lead)
        rows = rows.alias("a").join(self.small(edge).alias("b"), _same("a", "b") & (F.col("a.lead") == F.col("b.at"))).select("a.*", "b.left")
        sums = rows.groupBy("source", "left", digit.alias("at")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
        sums = sums.withColumn("before", upto - F.col("words"))
        return sums.where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("words"))).select(
            "source", "at", (F.col("left") - F.col("before")).alias("left"), "words", "n"
        )

    def _cuts(self, mixture: DataFrame) -> DataFrame:
        """(source, cut_h, cut_v, miss): the last pass takes rows up to the cut; miss is how far that is above the target.

        The row at the cut is taken if its middle lies below the target.  Rows of one hash have the
        same id and text; of those the first by v are taken.
        """
        # The range of the stream where the words pass what is left: the number of ranges that start at or before it, less one.
        at = F.size(F.filter(F.slice("starts", 1, _RANGES), lambda x: x <= F.col("left"))) - 1
        edge = mixture.where("left > 0").select("source", at.cast("long").alias("at"), "left", "starts")
        edge = edge.select("source", "at", (F.col("left") - F.element_at("starts", (F.col("at") + 1).cast("int"))).alias("left"))
        second, whole = F.shiftright("h", _BITS - _SECOND), F.col("h")
        edge = self._crossing(edge, _range().cast("long"), second).select("source", "at", "left")
        edge = self._crossing(edge, second, whole)
        edge = materialize(edge.withColumn("m", F.floor(F.col("left") / (F.col("words") / F.col("n")) + 0.5)), "edge")
        tied = edge.where((F.col("m") > 0) & (F.col("m") < F.col("n"))).select("source", "at", "m")
        cut_v = F.when(F.col("m") == 0, -1).when(F.col("m") == F.col("n"), _LAST)
        miss = F.col("m") * F.col("words") / F.col("n") - F.col("left")
        cuts = edge.select("source", F.col("at").alias("cut_h"), cut_v.alias("cut_v"), miss.alias("miss"))
        if not tied.isEmpty():
            rows = self.narrow.alias("a").join(self.small(tied).alias("b"), _same("a", "b") & (F.col("a.h") == F.col("b.at"))).select("a.source", "a.v", "b.m")
            rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("v"))).where(F.col("place") == F.col("m"))
            cuts = self._with(cuts, rows.select("source", F.col("v").alias("tied_v"))).withColumn("cut_v", F.coalesce("cut_v", "tied_v")).drop("tied_v")
        return cuts

    def _copies(self) -> Column:
        past = F.coalesce("cut_h", F.when(F.col("left") > 0, _LAST).otherwise(-1))
        last = (F.col("h") < past) | ((F.col("h") == past) & (F.col("v") <= F.col("cut_v")))
        return F.when(F.col("size") > 0, F.col("passes") + F.coalesce(last, F.lit(False)).cast("int")).otherwise(0).cast("int")

    def _fixes(self, mixture: DataFrame, cap: float) -> DataFrame:
        """(source, fix_h, fix_v, fix): the one row whose copy more or less brings its source's words nearest to the target."""
        rows = self.narrow.alias("a").join(self.small(mixture.where("miss <> 0").drop("starts")).alias("b"), _same("a", "b")).select("a.*", "passes", "left", "cut_h", "cut_v", "miss")
        rows = rows.withColumn("copies", self._copies()).withColumn("off", F.abs(F.abs("miss") - F.col("size")))
        able = F.when(F.col("miss") > 0, F.col("copies") > 0).otherwise(F.col("copies") + 1 <= cap)
        best = rows.where((F.col("size") > 0) & able & (F.col("off") < F.abs("miss"))).groupBy("source").agg(F.min(F.struct("off", "h", "v", "miss")).alias("best"))
        return best.select("source", F.col("best.h").alias("fix_h"), F.col("best.v").alias("fix_v"), F.when(F.col("best.miss") > 0, -1).otherwise(1).alias("fix"))

    def dealt(self, keyed: DataFrame) -> DataFrame:
        """(row, size, source_size, target, copies, positions) of keyed rows."""
        columns = "source source_size target passes left cut_h cut_v fix_h fix_v fix ramp starts".split()
        own = self.small(self.mixture.select(*columns)).alias("b")
        rows = keyed.alias("a").join(own, _same("a", "b")).select("a.*", *[f"b.{c}" for c in columns[1:]])
        fixed = F.when((F.col("h") == F.col("fix_h")) & (F.col("v") == F.col("fix_v")) & (F.col("size") > 0), F.col("fix")).otherwise(0)
        start, end = F.element_at("starts", _range() + 1), F.element_at("starts", _range() + 2)
        inside = (F.col("h").bitwiseAND((1 << (_BITS - _RANGE)) - 1) + 0.5) / float(1 << (_BITS - _RANGE))
        rows = rows.withColumn("copies", (self._copies() + fixed).cast("int")).withColumn("place", start + inside * (end - start))
        passes = F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>"))
        share = lambda k: F.least(F.lit(1.0), (F.col("place") + k * F.col("source_size")) / F.col("target"))
        positions = F.transform(passes, lambda k: _position(share(k), F.col("ramp")))
        return rows.select("row", "size", "source_size", "target", "copies", positions.alias("positions"))


def _position(share: Column, ramp: Column) -> Column:
    """Inverse of the integrated schedule, (1 + ramp) t - ramp t**2, at a share of the demand."""
    a = F.lit(1.0) + ramp
    root = F.sqrt(F.greatest(F.lit(0.0), a * a - ramp * share * 4.0))
    return F.when(ramp == 0, share).otherwise((a - root) / (ramp * 2.0))


def schedule(
    docs: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    weights: tuple[float, ...] = WEIGHTS,
    cap: float = MAX_EPOCHS,
    ramp: float = 0.5,
    seed: int = 8,
) -> DataFrame:
    """(row, size, source_size, target, copies, positions) for every row of docs.

    docs: doc_id, text, source; row is a struct of the columns in ``keep``, so other columns may
    have any names.  positions are the training positions, 0 to 1, of the row's copies, in order; a
    row the mix doesn't take has none.  A source's words first differ from its target by half a
    document at most; then the one copy more or less that brings them nearest to it is added or
    dropped.  No row gets more than ``ceil(cap)`` copies.  Null text and texts without words have
    size 0 and no copies; a null source is a source; an empty table gives none.  The order in a
    source is a hash of doc_id and text, so reruns agree.  Rows that repeat both share a place in
    the stream but are taken each for itself; which of them is taken depends on the scan's order,
    and those of one hash at a cut are numbered in one task.

    A row's place in its source's stream is interpolated within one of 256 hash ranges, whose words
    are known.  All sums are pre-aggregated, and just totals over all sources come to the driver.
    """
    mix = _Mix(docs, weights, cap, ramp, seed)
    return mix.dealt(mix.narrow if keep == ("doc_id",) else _keyed(docs, keep, seed))


def ordered(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = MAX_EPOCHS, ramp: float = 0.5, seed: int = 8) -> DataFrame:
    """schedule's rows by doc_id, with the copies read back from the mix: sorted by position in ranges, numbered over all.

    Returns row, size, source_size, target, copies, positions and places, the numbers of the row's
    copies in training order, from 0.  Rows without copies have none.  The copies carry no texts.
    """
    mix = _Mix(docs, weights, cap, ramp, seed)
    plan = materialize(mix.dealt(mix.narrow.withColumn("row", F.struct("row.doc_id", "source", "h", "v"))), "plan")
    copies = plan.select("row", F.explode("positions").alias("position")).repartitionByRange("position")
    sorted_copies = materialize(copies.sortWithinPartitions("position", "row.doc_id", "row.v").withColumn("part", F.spark_partition_id()), "copies")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = sorted_copies.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("position", "row.doc_id", "row.v")) - 1
    numbered = sorted_copies.withColumn("inside", inside).join(F.broadcast(starts), "part").withColumn("place", F.col("first") + F.col("inside"))
    back = numbered.groupBy("row.v").agg(F.count("*").cast("int").alias("copies"), F.array_sort(F.collect_list("position")).alias("positions"), F.array_sort(F.collect_list("place")).alias("places"))
    rows = plan.drop("copies", "positions").withColumn("v", F.col("row.v")).join(back, "v", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return rows.select(
        F.struct("row.doc_id").alias("row"), "size", "source_size", "target", F.coalesce("copies", F.lit(0)).alias("copies"),
        none("positions", "double"), none("places", "long"),
    )


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = MAX_EPOCHS, ramp: float = 0.5, seed: int = 8) -> DataFrame:
    """docs' rows and columns in training order: each as often as the mix takes it, sorted by position.

    Partition k of n holds the positions from k / n on, so written files are in training order too.
    The schedules of all sources add up to between half and one and a half of the mean at any
    time, and so do the partitions.  Same cases as ``schedule``.
    """
    mix = _Mix(docs, weights, cap, ramp, seed)
    copies = mix.dealt(_keyed(docs, tuple(docs.columns), seed)).select("row", F.explode("positions").alias("position"))
    n = max(4 * docs.sparkSession.sparkContext.defaultParallelism, -(-int(mix.words) // _PARTITION))
    dealt = copies.repartitionById(n, F.least(F.floor(F.col("position") * n), F.lit(n - 1)).cast("int"))
    ordered = dealt.sortWithinPartitions("position", "row.doc_id")
    return ordered.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
