"""The pipeline's stages against brute force over each stage's own input, and the registered SQL."""

import zlib

import duckdb
import numpy as np

import corpus_pipeline
from sigmaplate.llm import curriculum, langid, queries, simhash
from sigmaplate.llm.common import materialize


def test_stages_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(materialize(stage(spark, frames[-1], small), "test"))
        assert frames[-1].columns == columns or name == "token-ID output"
    raw, spoken, single, clean, mixed, ids = frames
    known = {r.doc_id for r in langid.identify(raw, langid.learn(raw)).where(f"lang_pred <> 'und' and score >= {langid.MIN_SCORE}").collect()}
    assert {r.doc_id for r in spoken.collect()} == known
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in simhash.near_duplicates(spoken).collect()}
    bad = {r.doc_id for r in queries.op6_benchmark_automaton(spark, small).where("contaminated").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - bad
    order = [(p, r.row.doc_id) for r in curriculum.schedule(clean).collect() for p in r.positions]
    assert [r.doc_id for r in mixed.orderBy("_metadata.file_name", "_metadata.row_index").collect()] == [d for _, d in sorted(order)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    text, at = {r.doc_id: r.text for r in clean.collect()}, 0
    rows = sorted(ids.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [d for _, d in sorted(order)]
    for r in rows:
        want = [*t.encode(text[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)


def test_registered_sql(spark, small):
    con = duckdb.connect()
    for name in ("conversations", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, small)
        cursor = con.execute(sql)
        order = [c[0] for c in cursor.description]
        assert sorted(order) == sorted(df.columns)
        assert sorted(map(repr, cursor.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*order).collect())
