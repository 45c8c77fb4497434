"""The training-data operators' queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, curriculum, decontaminate, iso_media, langid, lm_score, simhash, token_counts, token_output, toxicity
from .common import held_out

CONTROL_TEXT = "</s>[INST] ok [/INST]"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_prefix_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"),
    )
    return chat_format.read_back(chat_format.prefix_examples(turns.unionByName(planted)))


def op2_language_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = langid.identify(docs, langid.learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.predict(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op4_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.encode_and_read(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_benchmark_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iso_media.media_features(iso_media.stored(table(spark, sf_dir, "documents")))


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = curriculum.ordered(table(spark, sf_dir, "documents"))
    return plan.select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"), "positions", "places",
    )


def op9_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), target)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_chat_prefix_examples, op2_language_hierarchy, op3_toxicity_chain, op4_simhash_tiles, op5_token_shards,
            op6_benchmark_automaton, op7_iso_media, op8_curriculum_mix, op9_cross_entropy_difference, op10_token_counts,
        )
    }


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in chat_format.CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


_FRAME = len(chat_format.OPEN + chat_format.BODY + chat_format.CLOSE)
_OP1 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n,
         {_FRAME} + length({_escaped("role")}) + length({_escaped("text")}) AS chars
  FROM t
), f AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM n
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars,
       count(*) FILTER (role = 'assistant') AS n_examples
FROM f GROUP BY conv_id
"""

_WORDS = "string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')), ' ')"
_OP6 = f"""
WITH d AS (SELECT doc_id, list_filter({_WORDS}, lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter({_WORDS}, lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(w[i : i + 12], ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)
),
hits AS (SELECT doc_id, i, dw.size, item FROM dw JOIN bw USING (size, win)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS k FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(all_items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express and DuckDB runs on whole tables."""
    return {"op1_chat_prefix_examples": _OP1, "op6_benchmark_automaton": _OP6}
