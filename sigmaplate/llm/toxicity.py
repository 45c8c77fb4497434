"""Toxicity by a classifier chain of linear models over words, word beginnings and marks.

Categories are predicted in a fixed order, each by a logistic regression on the document's features
and on the probabilities of the categories before it.  For training, those earlier probabilities
come from models that didn't see the document (out-of-fold); for prediction, from the models fitted
on all of the sample.  The categories are the two that ``labels`` has: low quality (quality 0) first,
then toxic, whose link reads the probability of low quality and gives the decision.

Features are the presence of lower-cased words, of word beginnings of 4 to 6 characters and of runs
of two and more marks.  Each category keeps those that are much commoner in its positive documents
than in the others, so that the weight of a single telling word doesn't drown in a long text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batches, rows

#: Labelled documents of a class (toxic or not) that the chain is fitted on, at most.
PER_CLASS = 2000
FOLDS = 3
PREFIXES = (4, 5, 6)
#: Features a category keeps, its positive documents that a feature must be in, 1 in so many and a number, and its least log-odds.
KEPT, SHARE, SUPPORT, LOG_ODDS = 1024, 50, 4, 2.0
#: The categories in their order; the last one decides.
CATEGORIES = ("low_quality", "toxic")
_WORD = re.compile(r"[^\W\d_]+")
_MARKS = re.compile(r"[^\w\s]{2,}")


def tokens(text: str | None) -> set[str]:
    """Distinct lower-cased words, as they are, word beginnings, with a hyphen behind them, and runs of marks, with a point before them."""
    text = text or ""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "-" for w in words if len(w) >= 4 for n in PREFIXES if len(w) >= n} | {"." + m[:8] for m in set(_MARKS.findall(text))}


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def logistic_regression(x: np.ndarray, y: np.ndarray, penalty: float = 0.02, steps: int = 150) -> np.ndarray:
    """Weights, the bias last, by accelerated gradient steps; both classes weigh alike.

    penalty: L2, on all but the bias, against the mean loss.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())).astype(np.float32)
    ridge = np.append(np.full(x.shape[1] - 1, penalty / 10, np.float32), np.float32(0))
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):  # largest curvature, by power iteration
        v = x.T @ (weight * (x @ v))
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    rate = 1.0 / (0.25 * norm * 1.05 + penalty / 10 + 1e-9)
    w = u = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        grad = x.T @ (weight * (_logistic(x @ u) - y)) + ridge * u
        new = u - rate * grad
        u = new + np.float32(k / (k + 3.0)) * (new - w)
        w = new
    return w


@dataclass
class Link:
    """A category: its features' places, their weights, then those of the earlier categories, and the bias."""

    name: str
    vocabulary: dict[str, int]
    weights: np.ndarray

    def probability(self, found: set[str], earlier: list[float]) -> float:
        n = len(self.vocabulary)
        z = float(self.weights[-1]) + sum(float(self.weights[self.vocabulary[t]]) for t in found if t in self.vocabulary)
        z += sum(float(w) * p for w, p in zip(self.weights[n:-1], earlier, strict=True))
        return float(_logistic(np.array(z)))


class Sample:
    """Documents as arrays of feature numbers; ``names`` gives the features themselves."""

    def __init__(self, sets: Iterable[set[str]]) -> None:
        numbers: dict[str, int] = {}
        self.docs = [np.array([numbers.setdefault(t, len(numbers)) for t in sorted(s)], np.int32) for s in sets]
        self.names = list(numbers)

    def select(self, y: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
        """Features that tell the positive documents: by support times log-odds, ties by name."""
        docs = np.arange(len(self.docs)) if among is None else np.flatnonzero(among)

        def support(label: int) -> tuple[np.ndarray, int]:
            of = [self.docs[d] for d in docs if y[d] == label]
            return np.bincount(np.concatenate(of) if of else np.zeros(0, np.int64), minlength=len(self.names)), max(1, len(of))

        (hit, p), (rest, n) = support(1), support(0)
        odds = np.log((hit + 0.5) / (p + 1)) - np.log((rest + 0.5) / (n + 1))
        able = np.flatnonzero((hit >= max(SUPPORT, p / SHARE)) & (odds >= LOG_ODDS))
        order = sorted(able.tolist(), key=lambda t: (-hit[t] * odds[t], self.names[t]))
        return np.array(order[:KEPT], np.int64)

    def matrix(self, selected: np.ndarray, earlier: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
        place = np.full(len(self.names), -1)
        place[selected] = np.arange(len(selected))
        docs = np.arange(len(self.docs)) if among is None else np.flatnonzero(among)
        x = np.zeros((len(docs), len(selected)), np.float32)
        for r, d in enumerate(docs):
            at = place[self.docs[d]]
            x[r, at[at >= 0]] = 1
        return np.hstack([x, earlier[docs].astype(np.float32)])


def out_of_fold(sample: Sample, y: np.ndarray, earlier: np.ndarray, folds: np.ndarray) -> np.ndarray:
    """The probability of each document from a model fitted on the labelled documents of the other folds.

    y: 0, 1 or NaN for no label.  Where the other folds lack one of the classes it is their share of ones.
    """
    out = np.zeros(len(y), np.float32)
    for f in np.unique(folds):
        train, test = (folds != f) & ~np.isnan(y), folds == f
        if len(set(y[train].tolist())) < 2:
            out[test] = y[train].mean() if train.any() else 0.0
            continue
        of = sample.select(y, train)
        w = logistic_regression(sample.matrix(of, earlier, train), y[train])
        out[test] = _logistic(sample.matrix(of, earlier, test) @ w[:-1] + w[-1])
    return out


def fit_chain(sample: Sample, labels: dict[str, np.ndarray], folds: np.ndarray) -> list[Link]:
    """A link for each category in the order of ``labels`` (0, 1 or NaN for each document) that has both classes."""
    chain: list[Link] = []
    earlier = np.zeros((len(sample.docs), 0), np.float32)
    for name, y in labels.items():
        known = ~np.isnan(y)
        if len(set(y[known].tolist())) < 2:
            continue
        of = sample.select(y, known)
        weights = logistic_regression(sample.matrix(of, earlier, known), y[known])
        chain.append(Link(name, {sample.names[t]: k for k, t in enumerate(of)}, weights))
        earlier = np.hstack([earlier, out_of_fold(sample, y, earlier, folds)[:, None]])
    return chain


def _likeness(found: str) -> list[int]:
    """Two least hashes of the words of 8 letters and more, of which near copies share one; without such words the hash of all."""
    words = [t for t in found.split("\n") if len(t) >= 8 and t.isalpha()]
    return [min(xxhash.xxh3_64_intdigest(w, seed) for w in words) for seed in (1, 2)] if words else [xxhash.xxh3_64_intdigest(found)]


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list[Link]:
    """Fit the chain low_quality, toxic on a bounded sample of the labelled documents.

    labels: doc_id, quality and toxic (0 or 1).  Null toxic is unlabelled, null quality teaches
    nothing about quality; of repeated ids the largest toxic and the least quality count.  At most
    ``per_class`` documents of each class of toxic are taken, by a hash of the id; copies and most
    near copies of a text count once, so that what they share isn't taken for a feature of the class.  A category without labels of both classes in the sample has no link; without the
    classes of toxic the chain is empty.  A category's link keeps the KEPT features at most that
    tell its positive documents best, of those in 1 in SHARE of
    them, SUPPORT at least, and with log-odds of LOG_ODDS.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"), F.min("quality").cast("int").alias("quality"))
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if set(counts) != {0, 1}:
        return []
    span = 1 << 32
    place = F.xxhash64("doc_id", F.lit("toxicity")).bitwiseAND(span - 1)
    limit = F.when(F.col("toxic") == 1, min(span, int(span * 1.2 * per_class / counts[1]) + 1)).otherwise(min(span, int(span * 1.2 * per_class / counts[0]) + 1))
    chosen = marks.withColumn("place", place).where(F.col("place") < limit)
    picked = sorted(chosen.collect(), key=lambda r: (r["toxic"], r["place"], r["doc_id"]))
    picked = [r for y in (0, 1) for r in [r for r in picked if r["toxic"] == y][: per_class + per_class // 5]]
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["toxic"], r["quality"], r["place"]) for r in picked], "doc_id long, toxic int, quality int, place long")
    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most 2.4 * per_class rows
    names = ["doc_id", "place", "toxic", "quality"]
    schema = pa.schema([(n, pa.int64()) for n in names] + [("found", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = ((*r[:-1], "\n".join(sorted(tokens(r[-1])))) for r in rows(batches, *names, "text", at_once=64))
        yield from record_batches(got, schema)

    sample = picked.select(*names, "text").mapInArrow(run, "doc_id long, place long, toxic long, quality long, found string").collect()
    taken, seen, kept = Counter(), set(), []
    for r in sorted(sample, key=lambda r: (r["place"], r["doc_id"])):
        marks_of = {(k, r["toxic"]) for k in _likeness(r["found"])}
        if not marks_of & seen and taken[r["toxic"]] < per_class:
            seen |= marks_of
            taken[r["toxic"]] += 1
            kept.append(r)
    drawn = Sample(set(r["found"].split("\n")) - {""} for r in kept)
    low = np.array([np.nan if r["quality"] is None else 1 - r["quality"] for r in kept], np.float32)
    toxic = np.array([r["toxic"] for r in kept], np.float32)
    chain = fit_chain(drawn, dict(zip(CATEGORIES, (low, toxic), strict=True)), np.array([r["place"] % FOLDS for r in kept]))
    return chain if chain and chain[-1].name == CATEGORIES[-1] else []


def predict(docs: DataFrame, chain: list[Link], threshold: float = 0.35) -> DataFrame:
    """(doc_id, p_low_quality, p_toxic, toxic) of every row of docs (doc_id, text).

    toxic: the last link's probability is at least ``threshold``.  A link that isn't there gives 0,
    and so does every one for a text without features if there is no chain; null and empty texts have
    no features; repeated rows are judged each; other columns are ignored; an empty table gives none.
    No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    schema = pa.schema([("doc_id", pa.int64()), *[(f"p_{c}", pa.float64()) for c in CATEGORIES], ("toxic", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = shared.value
        keys = set().union(*[link.vocabulary for link in links]) if links else set()
        marks = {k for k in keys if k[0] == "."}
        parts = {k[:-1] for k in keys - marks if k[-1] == "-"}
        whole = {k for k in keys - marks if k[-1] != "-"}

        def found(text: str) -> set[str]:
            words = set(_WORD.findall(text.lower()))
            starts = {w[:n] for n in PREFIXES for w in words if len(w) >= n} & parts
            return words & whole | {s + "-" for s in starts} | {"." + m[:8] for m in set(_MARKS.findall(text))} & marks

        for batch in batches:
            probabilities = []
            for (text,) in rows(iter([batch]), "text", at_once=256):
                p: dict[str, float] = {}
                f = found(text or "") if links else set()
                for link in links:
                    p[link.name] = link.probability(f, list(p.values()))
                probabilities.append([p.get(c, 0.0) for c in CATEGORIES])
            columns = [batch.column(0), *[pa.array([p[k] for p in probabilities], pa.float64()) for k in range(len(CATEGORIES))], pa.array([p[-1] >= threshold for p in probabilities], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, p_low_quality double, p_toxic double, toxic boolean"
    )
