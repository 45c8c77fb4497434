"""Language ID by hierarchical discrimination: the family first, then its closely related languages.

A text is a vector of hashed byte 2- and 3-grams of its letters (lower-cased, in UTF-8, words
framed by spaces), square-rooted and scaled to length 1.  Linear support vector machines decide one
family against the others; in the winning family one-versus-one machines separate its languages by
vote, ties by the sum of margins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import learnable, rows

#: Families of closely related languages by ISO 639-1 code; others are families of their own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "ky", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "celtic": ["br", "cy", "ga", "gd"],
    "semitic": ["ar", "he", "mt"],
    "sinitic": ["yue", "zh"],
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
UNDETERMINED = "und"
DIMENSIONS = 4096
#: Documents of a language that the machines are fitted on, of all languages together, and languages, the commonest.
PER_LANGUAGE, SAMPLE, LANGUAGES = 400, 6000, 200
#: Least score that ``accepted`` takes: below it the margins speak against all families, as 0.25 is what two margins of 0 give.
#: Of the 2,499 held-out documents of the table of 10,000 the right ones score 0.377 and more.
MIN_SCORE = 0.2
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ASCII_LETTER = re.compile(r"[A-Za-z]")
_SEGMENT = 1 << 20


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def features(text: str) -> np.ndarray:
    """The vector of a whole text, in segments of bounded size."""
    data = b" " + b" ".join(text.encode().translate(_LETTERS).split()) + b" "
    counts = np.zeros(DIMENSIONS, np.float32)
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    for lo in range(0, len(data), _SEGMENT):
        b = np.frombuffer(data, np.uint8, min(_SEGMENT + 2, len(data) - lo), lo).astype(np.uint32)
        if len(b) < 2:
            break
        two = (b[:-1] << np.uint32(8) | b[1:])[:_SEGMENT]
        counts += np.bincount((two * np.uint32(2654435761)) >> shift, minlength=DIMENSIONS)
        three = two[: len(b) - 2] << np.uint32(8) | b[2:][: len(two)]
        counts += np.bincount(((three ^ (three >> np.uint32(11))) * np.uint32(2246822519)) >> shift, minlength=DIMENSIONS)
    np.sqrt(counts, out=counts)
    norm = float(np.sqrt(counts @ counts))
    return counts / norm if norm else counts


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 30, seed: int = 0) -> np.ndarray:
    """Weights, the bias last, of an L2-regularised hinge-loss machine by dual coordinate descent.

    y: -1 or 1; each class's cost is scaled to weigh as much as the other.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32)
    square = np.einsum("ij,ij->i", x, x)
    upper = cost * np.where(y > 0, len(y) / (2.0 * max(1, (y > 0).sum())), len(y) / (2.0 * max(1, (y < 0).sum())))
    alpha, w, rng = np.zeros(len(y)), np.zeros(x.shape[1], np.float32), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * float(w @ x[i]) - 1.0
            new = min(max(alpha[i] - g / square[i], 0.0), upper[i])
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


@dataclass
class Hierarchy:
    families: list[str]
    family_weights: np.ndarray
    languages: dict[str, list[str]]
    pairs: dict[str, list[tuple[int, int]]]
    pair_weights: dict[str, np.ndarray]

    @staticmethod
    def fit(x: np.ndarray, langs: list[str]) -> Hierarchy:
        """x: a row per document; deterministic in the order of the rows."""
        family = np.array([FAMILY.get(s, s) for s in langs])
        names, lang = sorted(set(family.tolist())), np.array(langs)
        one_sided = np.zeros((len(names), x.shape[1] + 1), np.float32)
        if len(names) > 1:
            one_sided = np.stack([linear_svm(x, np.where(family == f, 1.0, -1.0)) for f in names])
        languages, pairs, weights = {}, {}, {}
        for f in names:
            languages[f] = sorted(set(lang[family == f].tolist()))
            pairs[f] = list(combinations(range(len(languages[f])), 2))
            fitted = []
            for a, b in pairs[f]:
                of = (lang == languages[f][a]) | (lang == languages[f][b])
                fitted.append(linear_svm(x[of], np.where(lang[of] == languages[f][a], 1.0, -1.0)))
            weights[f] = np.stack(fitted) if fitted else np.zeros((0, x.shape[1] + 1), np.float32)
        return Hierarchy(names, one_sided, languages, pairs, weights)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and a score from 0 to 1, that of the family times that of the language in it."""
        if not self.families or not has_letter(text):
            return UNDETERMINED, 0.0
        v = np.append(features(text), np.float32(1))
        score = 1.0
        k = 0
        if len(self.families) > 1:
            margins = self.family_weights @ v
            k = int(np.argmax(margins))
            score = _logistic(float(margins[k]))
        family = self.families[k]
        langs = self.languages[family]
        if len(langs) == 1:
            return langs[0], score
        votes, sums = np.zeros(len(langs)), np.zeros(len(langs))
        margins = self.pair_weights[family] @ v
        for (a, b), m in zip(self.pairs[family], margins.tolist(), strict=True):
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
        best = max(range(len(langs)), key=lambda i: (votes[i], sums[i], -i))
        return langs[best], score * _logistic(float(sums[best]) / (len(langs) - 1))


def _logistic(margin: float) -> float:
    return float(1.0 / (1.0 + np.exp(-2.0 * np.clip(margin, -30, 30))))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE, languages: int = LANGUAGES) -> Hierarchy:
    """Fit on a bounded sample of labelled rows that aren't held out (see ``common.learnable``).

    Each of the ``languages`` commonest values of lang (ties by name) gives about ``per_language``
    documents, or its share of ``sample``, chosen by a hash of the id; copies of one text count
    once.  Texts without letters teach nothing.
    """
    labelled = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learnable())
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not counts:
        return Hierarchy([], np.zeros((0, DIMENSIONS + 1), np.float32), {}, {}, {})
    each = max(1, min(per_language, sample // len(counts)))
    span = 1 << 32
    limits = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(span, int(span * 1.25 * each / n) + 1))])
    place = F.xxhash64("doc_id", F.lit("sample")).bitwiseAND(span - 1)
    chosen = labelled.withColumn("place", place).where(F.col("place") < F.try_element_at(limits, F.col("lang")))
    schema = pa.schema([("lang", pa.string()), ("place", pa.int64()), ("same", pa.int64()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            got = [(s, p, zlib.crc32(t.encode()), features(t).astype("<f2").tobytes()) for s, p, t in rows(iter([batch]), "lang", "place", "text", at_once=64) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in got], f.type) for c, f in enumerate(schema)], schema=schema)

    vectors = chosen.select("lang", "place", "text").mapInArrow(run, "lang string, place long, same long, x binary").collect()
    seen, langs, x = {}, [], []
    for r in sorted(vectors, key=lambda r: (r["lang"], r["place"], r["same"])):
        mine = seen.setdefault(r["lang"], set())
        if r["same"] not in mine and len(mine) < each:
            mine.add(r["same"])
            langs.append(r["lang"])
            x.append(np.frombuffer(r["x"], "<f2"))
    if not x:
        return Hierarchy([], np.zeros((0, DIMENSIONS + 1), np.float32), {}, {}, {})
    return Hierarchy.fit(np.stack(x).astype(np.float32), langs)


def identify(docs: DataFrame, model: Hierarchy) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs (doc_id, text; other columns are ignored).

    ``und`` and 0 for null text and texts without a letter, or from a model that learned nothing;
    repeated rows are judged each; an empty table gives none.  No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for (t,) in rows(iter([batch]), "text", at_once=256)]
            columns = [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Hierarchy, languages: tuple[str, ...] | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """docs' rows in a wanted language (any learned one by default) with at least ``min_score``.

    Undetermined rows go.  A model that learned nothing keeps the texts with a letter.  Batches are
    filtered where they are scanned; same cases as ``identify``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value

        def keeps(text: str | None) -> bool:
            if not known.families:
                return has_letter(text)
            lang, score = known.predict(text)
            return lang != UNDETERMINED and score >= min_score and (languages is None or lang in languages)

        for batch in batches:
            yield batch.filter(pa.array([keeps(t) for (t,) in rows(iter([batch]), "text", at_once=256)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
