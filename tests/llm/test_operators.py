"""Every training-data operator against brute force, on awkward rows and on the smallest tables."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmaplate.llm import bpe, chat_format, curriculum, decontaminate, iso_media, langid, lm_score, queries, simhash, token_counts, token_output, tokenfile, toxicity

TOKENIZER = queries.tokenizer_path()
LONG = "all human beings are born free and equal in dignity and rights " * 3000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, "   \t\n ", "de", "b"),
    (5, LONG, "en", None),
    (6, LONG, "en", "b"),
    (6, LONG, "en", "b"),
    (7, "der schnelle braune Fuchs springt über den faulen Hund <|endoftext|> x", "de", "c"),
    (None, "no id at all", None, "c"),
    (8, "123 456", "de", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string, fp string, row long, size string, items string, n long, mark string"


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(*r, "x", 0, "y", "z", None, None) for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


# Tokens


def test_pieces_equal_the_library(library):
    coder = bpe.ByteBpe(TOKENIZER, cache=50)
    rng = random.Random(3)
    bits = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "a", "é", "漢", "1", "²", ".", "!?", "'s", "'", "<|endoftext|>", "_", "the", " ", "👍"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        assert coder.ids(text) == np.array(library(text), "<u4").tobytes(), repr(text)


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 16_384, 16_385, 70_000])
def test_shards_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 60_000).astype(np.uint32)
    data = tokenfile.encode([None, 5, 6], [n // 2, 0, n - n // 2], ids)
    back = tokenfile.decode(data)
    assert back.doc_ids == [None, 5, 6] and (back.ids == ids).all() and back.lengths.tolist() == [n // 2, 0, n - n // 2]
    if n > 100:
        broken = bytearray(data)
        broken[-3] ^= 1
        with pytest.raises(ValueError):
            tokenfile.decode(bytes(broken))


def check_shards(df, got, library):
    want, at = [], 0
    for doc_id, text in sorted(pairs(df), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*library(text), 2]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())


def test_token_output_in_file_order(spark, docs, awkward, empty, library, tmp_path):
    shuffled = docs.select("doc_id", "text", "source").repartitionByRange(3, F.xxhash64("doc_id")).sortWithinPartitions(F.xxhash64("doc_id"))
    shuffled.write.parquet(str(tmp_path / "mixed"))
    order = [r.doc_id for r in shuffled.collect()]
    text = dict(pairs(docs))
    at = 0
    got = sorted(token_output.encode_and_read(spark.read.parquet(str(tmp_path / "mixed")), TOKENIZER, by_file=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == order
    for r in got:
        ids = [*library(text[r.doc_id]), 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    path = str(tmp_path / "small")
    token_output.write_shards(spark.read.parquet(str(tmp_path / "mixed")), path, TOKENIZER, 2, shard_tokens=500, by_file=True)
    assert sorted(map(repr, token_output.read_shards(spark.read.parquet(path)).collect())) == sorted(map(repr, got))
    plain = token_output.encode_and_read(awkward, TOKENIZER, by_file=True).collect()  # no files
    assert sorted((str(r.doc_id), r.n_tokens) for r in plain) == sorted((str(d), len(library(t)) + 1) for d, t in pairs(awkward))
    assert sorted(r.start for r in plain)[0] == 0 and len({r.start for r in plain}) == len(plain)
    assert token_output.encode_and_read(empty, TOKENIZER, by_file=True).count() == 0


def test_token_output(docs, awkward, empty, library):
    check_shards(docs, token_output.encode_and_read(docs, TOKENIZER), library)
    check_shards(awkward, token_output.encode_and_read(awkward, TOKENIZER), library)
    assert token_output.encode_and_read(empty, TOKENIZER).count() == 0


@pytest.mark.parametrize("chunk", [4096, 100])
def test_token_counts(docs, awkward, empty, library, chunk):
    for df in (docs, awkward):
        got = token_counts.token_counts(df, TOKENIZER, chunk=chunk, overlap=chunk // 16)
        want = [(d, len((t or "").encode()), len(library(t)), len(library(t)) > 512) for d, t in pairs(df)]
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
    assert token_counts.token_counts(empty, TOKENIZER).count() == 0


def test_splice_widens_without_spaces(library):
    coder = bpe.ByteBpe(TOKENIZER, cache=500)
    rng = random.Random(1)
    bits = [" ", "  ", "\n", "\x1c", "\xa0", "a", "é", "漢", "1", ".", "'s", "<|endoftext|>", "the", "👍"]
    texts = ["x" * 5000, "ab cd " + "y" * 3000 + " end " * 400, " " * 2000 + "z", "".join(rng.choice("ab c\n é") for _ in range(4000))]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    for text in texts:
        for chunk, overlap in ((200, 8), (7, 2)):
            ids = b"".join(token_counts.splice(text, coder.parts, chunk, overlap))
            assert ids == np.array(library(text), "<u4").tobytes(), repr(text)


def test_other_tokenizer_files_are_encoded_whole(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    df = spark.createDataFrame([(1, "A Test  of\tpieces " * 2000), (2, None)], "doc_id long, text string")
    want = {1: len(Tokenizer.from_file(path).encode("A Test  of\tpieces " * 2000, add_special_tokens=False).ids), 2: 0}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, path).collect()} == want


def test_counts_of_a_model_file(spark):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    df = spark.createDataFrame([(1, "a test  of pieces"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, path).collect()} == {1: len(model.encode("a test  of pieces")), 2: 0}


# Chat formatting


def test_escape_is_reversible(spark):
    rng = random.Random(2)
    bits = ["\\", "<", "|", "<|", "[INST]", "[/INST]", "</s>", "<s>", "s>", "INST]", "[", "<|turn|>", "é", "\n", "<\\|", "<<SYS>>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 8))) for _ in range(500)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e"), chat_format.unescape(chat_format.escape(F.col("t"))).alias("b")).collect()
    assert all(r.t == r.b and not any(c in r.e for c in chat_format.CONTROLS) for r in got)


def test_chat_examples(spark):
    rows = [
        (1, 0, "user", "<|end|> \\ hi"), (1, 1, "assistant", "A</s>"), (1, 2, "user", None), (1, 3, "assistant", "ß\\"), (1, 4, "user", "tail"),
        (2, 0, "system", "only"), (None, None, None, None), (3, 1, "assistant", ""), (3, 1, "assistant", ""), (4, 7, "assistant", LONG),
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    examples = chat_format.prefix_examples(df)
    assert sorted((r.conv_id or -1, r.n_turns, r.final, r.trainable) for r in examples.collect()) == sorted(
        [(1, 2, False, True), (1, 4, False, True), (1, 5, True, False), (2, 1, True, False), (-1, 1, True, False), (3, 1, False, True), (3, 2, True, True), (4, 1, True, True)]
    )
    got = {r.conv_id: r for r in chat_format.read_back(examples).collect()}
    talks = defaultdict(list)
    for c, t, role, text in rows:
        talks[c].append((t, role or "", text or ""))
    for c, turns in talks.items():
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.read_back(chat_format.prefix_examples(df.limit(0))).count() == 0
    plan = chat_format.prefix_examples(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Near duplicates


def linked(fps):
    ids = sorted(fps, key=lambda d: (d is None, d))
    a = np.array([fps[d] for d in ids], np.uint64)
    label = np.arange(len(ids))
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 3
    while True:
        new = np.where(near, label[None, :], len(ids)).min(1)
        if (new == label).all():
            return {d: ids[k] for d, k in zip(ids, label.tolist())}
        label = new


def slow_fingerprint(text):
    import xxhash

    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(docs, awkward, empty):
    for df in (docs, awkward):
        got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
        fps = {d: slow_fingerprint(t) for d, t in pairs(df)}
        assert {d: r.fp & (1 << 64) - 1 for d, r in got.items()} == fps
        assert {d: r.component_id for d, r in got.items()} == linked(fps)
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_finds_all_links_in_crowded_blocks(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 6, np.uint64)
    fps = {int(b) for b in base}
    for b in base[:3]:  # chains and stars around shared block values
        x = int(b)
        for _ in range(150):
            x ^= 1 << int(rng.integers(0, 64))
            fps.add(x)
    fps |= {int(v) & ~0xFFFF for v in rng.integers(0, 1 << 63, 400, np.uint64)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for rows, blocks in ((4096, None), (50, None), (50, 5), (50, 6), (7, 4)):
        tree = simhash.components(simhash.links(df, slice_rows=rows, blocks=blocks)).collect()
        root = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in tree}
        want = linked(dict(enumerate(fps)))
        groups, found = defaultdict(set), defaultdict(set)
        for k, f in enumerate(fps):
            groups[want[k]].add(f)
            found[root.get(f, f)].add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_one_document_of_each_group_stays(docs, awkward):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(got.values())
    assert sorted(str(r.doc_id) for r in simhash.keep_representatives(awkward).collect()) == sorted(["1", "2", "5", "7", "8", "None"])


def test_each_group_keeps_one_row_whatever_its_ids(spark):
    one, two, three, four = ("the first text of all these", "quite another text about something", "a third one that is alone here", "fourth words nobody else has said")
    rows = [(1, one), (None, one), (None, two), (None, two), (None, three), (5, one), (5, four), (1, one)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(repr, simhash.keep_representatives(df.repartition(3)).collect()))
    assert kept == sorted(map(repr, spark.createDataFrame([(1, one), (None, two), (None, three), (5, four)], df.schema).collect()))


# Decontamination


def slow_contamination(text, items):
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    words, hit, found = cut(text), set(), set()
    for item, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            win = w[k : k + 13]
            for i in range(len(words) - len(win) + 1):
                if words[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found |= {str(item)} if item is not None else set()
    ids = ",".join(sorted(found))
    return len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def test_decontamination(spark, awkward, empty):
    items = [(1, "Born FREE, and equal"), (10, " ".join(f"w{i}" for i in range(20))), (2, "Über den"), (3, None), (4, "--"), (5, "born free and"), (5, "dog"), (None, "again")]
    bench = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id int")
    planted = "x w5 W6-w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18 no " * 2
    more = awkward.unionByName(spark.createDataFrame([(90, planted), (91, "w5 w6 w7")], "doc_id long, text string"), allowMissingColumns=True)
    judged = [(d, slow_contamination(t, items)) for d, t in pairs(more)]
    want, bad = sorted(repr((d, *r)) for d, r in judged), {d for d, r in judged if r[4]}
    assert bad and len(bad) < len(want)
    for size in (3_000_000, 15):
        got = decontaminate.contamination(more.drop("row"), bench, max_words=size)
        assert sorted(repr(tuple(r)) for r in got.drop("row", "items", "spans").collect()) == want
        (found,) = got.where("doc_id = 90").collect()
        assert [planted[s.start : s.end] for s in found.spans] == ["w5 W6-w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18"] * 2
        kept = decontaminate.clean(more, bench, max_words=size)
        assert kept.columns == more.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in pairs(more)} - bad
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(more.drop("row"), bench.limit(0)).where("n_hit > 0").count() == 0


def test_a_column_called_row_changes_nothing(spark):
    bench = spark.createDataFrame([(1, "red green blue"), (2, "one two three")], "item_id long, text string")
    texts = [(1, "red green blue x", "same"), (1, "one two three y", "same"), (1, "red green blue x", "same"), (2, "none of it", "other")]
    df = spark.createDataFrame(texts, "doc_id long, text string, row string")
    for size in (3_000_000, 3):
        got = decontaminate.contamination(df, bench, max_words=size).select("doc_id", "n_words", "n_hit", "n_items").collect()
        assert sorted(tuple(r) for r in got) == [(1, 4, 3, 1)] * 3 + [(2, 3, 0, 0)]


def test_windows_at_every_place_are_found():
    rng = random.Random(5)
    for window in (1, 2, 5, 12, 13):
        vocabulary = [f"v{k}" for k in range(4)]
        items = [(k % 7, " ".join(rng.choices(vocabulary, k=rng.randint(1, 40)))) for k in range(12)]
        matcher = decontaminate.Matcher(items, window)
        for _ in range(60):
            doc = rng.choices([*vocabulary, "zz"], k=rng.randint(0, 60))
            hit, found = set(), set()
            for item, text in items:
                w = text.split()
                size = min(window, len(w))
                for s in range(len(w) - size + 1):
                    for i in range(len(doc) - size + 1):
                        if doc[i : i + size] == w[s : s + size]:
                            hit.update(range(i, i + size))
                            found.add(item)
            n, ranges, names = matcher.scan(" ".join(doc))
            assert n == len(doc) and {k for a, b in ranges for k in range(a, b)} == hit and names == found


def test_a_large_benchmark(spark):
    rng = np.random.default_rng(6)
    words = np.array([f"{k:x}" for k in range(30_000)])
    items = [(k, " ".join(words[rng.zipf(1.4, n) % len(words)])) for k, n in enumerate(rng.integers(3, 400, 2000).tolist())]
    items.append((2000, " ".join(words[rng.integers(0, len(words), 250_000)])))  # longer than a segment
    windows = defaultdict(set)
    for k, t in items:
        w = t.split()
        for s in range(max(1, len(w) - 12)):
            windows[tuple(w[s : s + 13])].add(k)
    docs = []
    for k in range(120):
        some = items[int(rng.integers(0, len(items)))][1].split()
        at = int(rng.integers(0, len(some)))
        docs.append((k, " ".join([*words[rng.zipf(1.4, 150) % len(words)], *some[at : at + 30], *words[rng.integers(0, 30_000, 5)]])))
    docs.append((999, " ".join(t for _, t in items[1990:])))
    want = {}
    for k, t in docs:
        w, hit, found = t.split(), set(), set()
        for size in range(3, 14):
            for i in range(len(w) - size + 1):
                if of := windows.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= of
        want[k] = (len(w), len(hit), sorted(map(str, found)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (3_000_000, 200_000):
        got = decontaminate.contamination(df, bench, max_words=size).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == want


# Media


def test_media(docs, awkward, empty):
    for df in (docs, awkward):
        texts = defaultdict(list)
        for d, t in pairs(df):
            texts[d].append(t)
        media = iso_media.stored(df)
        held = {(r.doc_id, hashlib.sha256(r.media).hexdigest()): bytes(r.media) for r in media.collect()}
        got = iso_media.media_features(media).collect()
        assert len(got) == df.count()
        for r in got:
            raw = (texts[r.doc_id][0] or "").encode()
            payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
            data = held[r.doc_id, r.media_sha256]
            samples = len(payload) // 576
            first = data.index(b"mdat") + 4
            keys = [(first + k * 576, 576) for k in range(0, samples, 8)]
            packed = b"".join(v.to_bytes(8, "big") for pair in keys for v in pair)
            assert (r.media_bytes, r.codec, r.duration) == (len(data), "raw", samples * 576 / 8000) and data[first:] == payload
            assert [tuple(k) for k in r.key_ranges] == keys
            assert r.feature == f"codec=raw;handler=soun;duration={samples * 576}/8000;samples={samples};keys={len(keys)};first={first}+576;ranges={zlib.crc32(packed):08x}"
    assert iso_media.media_features(iso_media.stored(empty)).count() == 0


def test_batches_are_cut_by_bytes(monkeypatch):
    import pyarrow as pa

    from sigmaplate.llm import common

    monkeypatch.setattr(common, "BATCH_BYTES", 1000)
    schema = pa.schema([("a", pa.int64()), ("b", pa.binary())])
    made = list(common.record_batches(((k, b"x" * 400) for k in range(10)), schema))
    assert [b.num_rows for b in made] == [3, 3, 3, 1]
    long = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([b"y" * 900] * 6)], schema=schema)
    assert [r[0] for r in common.rows(iter([long, *made]), "a", "b")] == [*range(6), *range(10)]


def test_box_walker():
    data = iso_media.mux(bytes(range(256)) * 9 * 20)
    (track,) = iso_media.probe(data)
    assert (track.codec, track.handler, track.timescale, track.ticks, len(track.sizes)) == ("raw ", "soun", 8000, 46080, 80)
    assert [data[a : a + n] for a, n in track.key_ranges()] == [(bytes(range(256)) * 180)[k * 576 * 8 :][:576] for k in range(10)]
    wide = iso_media.box(b"wide") + data[:20] + data[20:]
    assert iso_media.probe(wide)[0].offsets == track.offsets  # offsets are absolute, boxes before shift nothing in the table
    with pytest.raises(ValueError):
        list(iso_media.walk(data[:-5]))
    with pytest.raises(ValueError, match="fragment"):
        iso_media.probe(data + iso_media.box(b"moof", iso_media.box(b"traf")))
    fixed = iso_media.full(b"stsz", 0, (576).to_bytes(4, "big"), (80).to_bytes(4, "big"))
    small = iso_media.full(b"stz2", 0, bytes([0, 0, 0, 16]), (80).to_bytes(4, "big"), (576).to_bytes(2, "big") * 80)
    grown = len(small) - len(fixed)
    at = data.index(fixed)
    compact = bytearray(data[:at] + small + data[at + len(fixed) :])
    for kind in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
        k = compact.index(kind) - 4
        compact[k : k + 4] = (int.from_bytes(compact[k : k + 4], "big") + grown).to_bytes(4, "big")
    (other,) = iso_media.probe(bytes(compact))
    assert other.sizes == track.sizes and other.offsets == track.offsets
    assert iso_media._compact(bytes([0x12, 0x30]), 0, 4, 3) == [1, 2, 3] and iso_media._compact(bytes([7, 9]), 0, 8, 2) == [7, 9]


# Mixing


def slow_targets(sizes, weights=(5.0, 2.0, 1.0), cap=3.0):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, free = {}, list(order)
    while free:
        share = (sum(sizes.values()) - sum(out.values())) / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > cap * sizes[s]]
        if not over:
            return out | {s: share * weight[s] for s in free}
        out |= {s: cap * sizes[s] for s in over}
        free = [s for s in free if s not in over]
    return out


def test_targets_reshare_the_excess(spark):
    rng = random.Random(7)
    names = [None, *{"".join(rng.choices("ab\U0001f600\uffffz", k=3)) for _ in range(60)}]
    for sizes in ({"a": 10, "b": 1000, None: 50}, {}, {"a": 0}, {s: int(10 ** rng.uniform(0, 5)) for s in names}, {"x": 5, "y": 0}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(3)
        got = {r.source: r.target for r in curriculum.targets(df)[0].collect()}
        assert got == {s: pytest.approx(t) for s, t in slow_targets(sizes).items()}
        assert curriculum.targets(df)[1:] == (len(sizes), pytest.approx(sum(got.values())))
    df = spark.createDataFrame([("a", 10), ("b", 30)], "source string, source_size long")
    assert {r.source: r.target for r in curriculum.targets(df, cap=0.5)[0].collect()} == {"a": 5.0, "b": 15.0}


def integral(t, ramp):
    return (1 + ramp) * t - ramp * t * t


def test_schedule(spark, docs, awkward, empty):
    from pyspark.sql import Row

    for df in (docs, awkward):
        got = curriculum.schedule(df, keep=("doc_id", "source", "text")).collect()
        assert len(got) == df.count()
        assert all(r.size == len((r.row.text or "").split()) and len(r.positions) == r.copies <= 3 for r in got if "\x1c" not in (r.row.text or ""))
        of = defaultdict(list)
        for r in got:
            of[r.row.source].append(r)
        size = {s: sum(r.size for r in rs) for s, rs in of.items()}
        target = slow_targets(size)
        names = sorted((s for s in of if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in of if s is None]
        hashes = {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", F.xxhash64("doc_id", "text", F.lit(8)).bitwiseAND((1 << 52) - 1).alias("h")).collect()}
        for k, s in enumerate(names):
            rs = of[s]
            assert {r.source_size for r in rs} == {size[s]} and all(r.target == pytest.approx(target[s]) for r in rs)
            taken = sum(r.size * r.copies for r in rs)
            assert abs(taken - target[s]) <= max(r.size for r in rs) / 2 + 1e-6
            words = [0] * 257
            for r in rs:
                words[(hashes[r.row.doc_id, r.row.text] >> 44) + 1] += r.size
            starts = np.cumsum(words)
            ramp = -0.5 if k % 2 else 0.5
            for r in rs:
                h = hashes[r.row.doc_id, r.row.text]
                place = starts[h >> 44] + ((h & (1 << 44) - 1) + 0.5) / 2**44 * (starts[(h >> 44) + 1] - starts[h >> 44])
                want = [min(1.0, (place + c * size[s]) / target[s]) for c in range(r.copies)]
                assert [integral(p, ramp) for p in r.positions] == pytest.approx(want, abs=1e-9)
                assert all(0 <= p <= 1 for p in r.positions)
        again = curriculum.schedule(df, keep=("doc_id", "source", "text")).collect()
        assert sorted(map(repr, again)) == sorted(map(repr, got))
        assert {(r.row.doc_id, r.size, r.copies) for r in curriculum.schedule(df).collect()} == {(r.row.doc_id, r.size, r.copies) for r in got}
        mixed = curriculum.mixed(df)
        order = sorted(((p, r.row.doc_id is not None, r.row.doc_id, r.row.text) for r in got for p in r.positions), key=lambda x: (x[0], x[1], x[2] or 0))
        assert mixed.columns == df.columns and [(r.doc_id, r.text) for r in mixed.collect()] == [x[2:] for x in order]
    assert curriculum.schedule(empty).count() == 0 and curriculum.mixed(empty).count() == 0
    same = spark.createDataFrame([Row(doc_id=1, text="a b c", source="s")] * 50 + [Row(doc_id=2, text="x y", source="t")] * 3).repartition(4)
    got = curriculum.schedule(same, keep=("source",)).collect()
    taken = {s: sum(r.size * r.copies for r in got if r.row.source == s) for s in "st"}
    assert taken["t"] == 18 and abs(taken["s"] - 138) <= 3


# Models


def slow_language(text, model):
    words = bytes(b | 32 if chr(b).isalpha() and b < 128 else b if b >= 128 else 32 for b in (text or "").encode()).split()
    data = b" " + b" ".join(words) + b" "
    counts = defaultdict(int)
    for n in (2, 3):
        for i in range(len(data) - n + 1):
            g = int.from_bytes(data[i : i + n], "big")
            g = g * 2654435761 if n == 2 else (g ^ g >> 11) * 2246822519
            counts[(g & 0xFFFFFFFF) >> 20] += 1
    norm = math.sqrt(sum(counts.values()))
    dot = lambda w: float(w[-1]) + sum(float(w[k]) * math.sqrt(n) / norm for k, n in counts.items())
    prob = lambda m: 1 / (1 + math.exp(-2 * m))
    margins = [dot(w) for w in model.family_weights]
    k = margins.index(max(margins))
    langs = model.languages[model.families[k]]
    votes, sums = [0] * len(langs), [0.0] * len(langs)
    for (a, b), w in zip(model.pairs[model.families[k]], model.pair_weights[model.families[k]]):
        m = dot(w)
        votes[a if m >= 0 else b] += 1
        sums[a] += m
        sums[b] -= m
    best = max(range(len(langs)), key=lambda i: (votes[i], sums[i]))
    return langs[best], prob(margins[k]) * (prob(sums[best] / (len(langs) - 1)) if len(langs) > 1 else 1.0)


def test_language_id(spark, docs, awkward, empty):
    model = langid.learn(docs)
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(queries.held_out()).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    odd = {r.doc_id: r for r in langid.identify(awkward, model).collect()}
    assert all(odd[d].lang_pred == "und" and odd[d].score == 0 for d in (2, 3, 4, 8)) and all(0 <= r.score <= 1 for r in odd.values())
    kept = langid.accepted(awkward, model)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} == {d for d, r in odd.items() if r.lang_pred != "und" and r.score >= langid.MIN_SCORE}
    assert {r.doc_id for r in langid.accepted(awkward, model, min_score=1.1).collect()} == set()
    nothing = langid.learn(empty)
    assert {r.doc_id for r in langid.accepted(awkward, nothing).collect()} == {1, 5, 6, 7, None}
    assert {lang for f in langid.learn(docs, languages=2).languages.values() for lang in f} == {r.lang for r in docs.where(~queries.held_out()).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(2).collect()}
    # The whole table's predictions from plain dictionaries of n-grams and the fitted weights.
    for r in langid.identify(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert (r.lang_pred, r.score) == (slow_language(r.text, model)[0], pytest.approx(slow_language(r.text, model)[1], abs=1e-4))
    assert langid.identify(empty, nothing).count() == 0 and {r.lang_pred for r in langid.identify(awkward, nothing).collect()} == {"und"}
    # Only the language of rows that may be learned from counts.
    hidden = docs.withColumn("lang", F.when(queries.held_out(), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    assert sorted(map(repr, langid.identify(hidden, langid.learn(hidden)).collect())) == sorted(map(repr, langid.identify(docs, model).collect()))


def test_toxicity(spark, awkward, empty):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    half = F.col("doc_id") % 2 == 0
    chain = toxicity.learn(docs, labels.where(half))
    assert [link.name for link in chain] == ["low_quality", "toxic"] and len(chain[1].weights) == len(chain[1].vocabulary) + 2
    got = toxicity.predict(docs, chain).select("doc_id", F.col("toxic").alias("found")).join(labels.where(~half), "doc_id").collect()
    assert sum(r.found for r in got if r.toxic) >= 0.9 * sum(r.toxic for r in got)
    assert sum(r.found for r in got if not r.toxic) <= 0.03 * sum(1 - r.toxic for r in got)
    # Rows by hand: features, then one link after the other.
    docs = docs.where("doc_id < 1000")
    text = dict(pairs(docs))
    for r in toxicity.predict(docs, chain).collect():
        found, p = toxicity.tokens(text[r.doc_id]), []
        for link in chain:
            n = len(link.vocabulary)
            z = float(link.weights[-1]) + sum(float(link.weights[link.vocabulary[t]]) for t in found & set(link.vocabulary))
            p.append(1 / (1 + math.exp(-z - sum(float(w) * q for w, q in zip(link.weights[n:-1], p)))))
        assert (r.p_low_quality, r.p_toxic, r.toxic) == (pytest.approx(p[0], abs=1e-5), pytest.approx(p[1], abs=1e-5), p[1] >= 0.35)
    blank = {r.doc_id: tuple(r)[1:] for r in toxicity.predict(awkward, chain).collect()}
    assert len(blank) == len({d for d, *_ in ROWS}) and blank[2] == blank[3] == blank[4] == blank[8] and not blank[2][2]
    assert toxicity.predict(awkward, chain).count() == len(ROWS) and toxicity.predict(empty, chain).count() == 0
    assert toxicity.learn(docs, labels.limit(0)) == [] and toxicity.predict(awkward, []).where("toxic or p_toxic > 0").count() == 0
    only = toxicity.learn(docs, labels.withColumn("quality", F.lit(None).cast("int")))
    assert [link.name for link in only] == ["toxic"] and toxicity.predict(awkward, only).where("p_low_quality <> 0").count() == 0


def test_chain_trains_on_out_of_fold_probabilities():
    rng = np.random.default_rng(9)
    sets = [{f"w{k}" for k in rng.integers(0, 40, 12)} | ({"bad"} if d % 3 == 0 else {"good"}) for d in range(120)]
    sample, folds = toxicity.Sample(sets), np.arange(120) % 3
    a = np.array([d % 3 == 0 for d in range(120)], np.float32)
    b = np.array([d % 6 == 0 for d in range(120)], np.float32)
    a[5] = np.nan
    none = np.zeros((120, 0), np.float32)
    out = toxicity.out_of_fold(sample, a, none, folds)
    for f in range(3):  # the same from a sample that lacks the fold's documents
        train = (folds != f) & ~np.isnan(a)
        apart = toxicity.Sample([s for s, t in zip(sets, train) if t])
        of = apart.select(a[train])
        w = toxicity.logistic_regression(apart.matrix(of, np.zeros((train.sum(), 0))), a[train])
        link = toxicity.Link("a", {apart.names[t]: k for k, t in enumerate(of)}, w)
        assert [link.probability(sets[d], []) for d in np.flatnonzero(folds == f)] == pytest.approx(out[folds == f].tolist(), abs=2e-3)
    first, second = toxicity.fit_chain(sample, {"a": a, "b": b}, folds)
    of = sample.select(b)
    assert second.weights == pytest.approx(toxicity.logistic_regression(sample.matrix(of, out[:, None]), b), abs=1e-6)
    assert abs(second.weights[-2]) > 0.1


def test_lm_score(spark, awkward, empty):
    counts = {}

    def words(text):
        return (text or "").encode().lower().split()

    rows = [(k, " ".join(random.Random(k).choices(["red", "green", "Blue", "x"] if k % 2 else ["uno", "dos", "x"], k=12))) for k in range(40)] + [(99, None), (None, "red red")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(k, 0) for k in range(1, 40, 2)] + [(1, 0), (None, 0)], "doc_id long, text int")
    got = {r.doc_id: r for r in lm_score.cross_entropy_difference(df, target).collect()}
    assert all(got[k].score < 0 if k % 2 else got[k].score > 0 for k in range(40)) and got[99].n_words == 0 and got[99].score == 0
    # The same figures from exact dictionaries of words and pairs.
    for k, text in rows:
        w = words(text)
        mine = 0 if k is not None and k < 40 and k % 2 else 1
        for a, b in zip([b"<s>", *w], w):
            counts[mine, a, b] = counts.get((mine, a, b), 0) + 1
            counts[mine, b] = counts.get((mine, b), 0) + 1
            counts[mine] = counts.get(mine, 0) + 1
    vocabulary = len({key[1] for key in counts if isinstance(key, tuple) and len(key) == 2}) + 1
    text, loss = dict(rows)[7], [0.0, 0.0]
    w = words(text)
    for m in (0, 1):
        own = [("<s>".encode(), w[0]), *zip(w, w[1:])]
        less = lambda key: 0 if m else sum(x == key for x in own)
        for k, (a, b) in enumerate(own):
            n = counts.get((m, b), 0) - (0 if m else w.count(b))
            base = (n + 1) / (counts[m] - (0 if m else len(w)) + vocabulary)
            pair = counts.get((m, a, b), 0) - less((a, b))
            context = pair if k == 0 else counts.get((m, a), 0) - (0 if m else w.count(a))
            loss[m] -= np.log((min(pair, context) + lm_score.MU * base) / (context + lm_score.MU)) / len(w)
    assert (got[7].target_loss, got[7].background_loss) == (pytest.approx(loss[0], rel=1e-5), pytest.approx(loss[1], rel=1e-5))
    for t in (target, target.limit(0)):
        odd = lm_score.cross_entropy_difference(awkward, t).collect()
        assert sorted((str(r.doc_id), r.n_words) for r in odd) == sorted((str(d), len(words(x))) for d, x, *_ in ROWS)
        assert all(math.isfinite(r.score) and r.score == pytest.approx(r.target_loss - r.background_loss) for r in odd)
        assert all((r.target_loss, r.background_loss, r.score) == (0, 0, 0) for r in odd if r.n_words == 0)
        assert len({(r.doc_id, r.score) for r in odd if r.doc_id == 6}) == 1
    assert lm_score.cross_entropy_difference(empty, target).count() == 0


def test_lm_score_joins_many_targets(spark, docs, monkeypatch):
    target = docs.where("doc_id % 3 = 0").select("doc_id")
    want = lm_score.cross_entropy_difference(docs, target).collect()
    monkeypatch.setattr(lm_score, "MAX_IDS", 3)
    got = lm_score.cross_entropy_difference(docs, target).collect()
    assert sorted(map(repr, want)) == sorted(map(repr, got))


@pytest.mark.parametrize("most", [1 << 21, 1000])
def test_lm_score_counts_every_word_and_pair(spark, monkeypatch, most):
    monkeypatch.setattr(lm_score, "SLICE", most)
    rng = random.Random(8)
    common = [f"w{k}" for k in range(5000)]
    slots = lm_score.hash_words(" ".join(common)) >> np.uint64(44)
    assert len(set(slots.tolist())) < len(common)  # 2^20 slots would merge some of them
    texts = {k: rng.choices(common[k % 2 :: 2], k=40_000 if k < 4 else 60) + [f"once{k}"] for k in range(40)}
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in lm_score.cross_entropy_difference(df, df.where("doc_id % 2 = 1").select("doc_id")).collect()}
    seen = defaultdict(int)
    for w in texts.values():
        for x in w:
            seen[x] += 1
    texts = {k: [x if seen[x] >= lm_score.MIN_COUNT else None for x in w] for k, w in texts.items()}
    one, two, total = defaultdict(int), defaultdict(int), [0, 0]
    for k, w in texts.items():
        m = 1 - k % 2
        total[m] += len(w)
        for h, x in zip(["", *w], w):
            one[m, x] += 1
            two[m, h, x] += 1
    vocabulary = sum(n >= lm_score.MIN_COUNT for n in seen.values()) + 1
    for k, w in texts.items():
        loss = [0.0, 0.0]
        for m in (0, 1):
            mine = m == 1 - k % 2
            own_one, own_two = defaultdict(int), defaultdict(int)
            for h, x in zip(["", *w], w) if mine else ():
                own_one[x] += 1
                own_two[h, x] += 1
            for h, x in zip(["", *w], w):
                pair = two[m, h, x] - own_two[h, x]
                context = pair if h == "" else one[m, h] - own_one[h]
                base = (one[m, x] - own_one[x] + 1) / (total[m] - mine * len(w) + vocabulary)
                loss[m] -= math.log((min(pair, context) + lm_score.MU * base) / (context + lm_score.MU)) / len(w)
        assert (got[k].target_loss, got[k].background_loss) == (pytest.approx(loss[0], rel=1e-9), pytest.approx(loss[1], rel=1e-9))


def test_readers_of_shards_keep_no_encoder():
    bpe.encoder(TOKENIZER).many(["some words to keep"])
    assert bpe._loaded and list(token_output._documents(iter([]))) == [] and not bpe._loaded


def test_mix_query_orders_its_copies(spark, small):
    found = queries.op8_curriculum_mix(spark, small).collect()
    plan = {r.row.doc_id: r for r in curriculum.schedule(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    assert len(found) == len(plan) and all((r.taken, r.positions) == (r.size * plan[r.doc_id].copies, plan[r.doc_id].positions) for r in found)
    order = sorted((p, r.doc_id) for r in found for p in r.positions)
    assert [d for _, d in sorted((at, r.doc_id) for r in found for at in r.places)] == [d for _, d in order]
    assert sorted(at for r in found for at in r.places) == list(range(len(order)))
