"""The registered queries of this folder; each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from docmark.llm import (
    chat_format,
    decontaminate,
    divergence,
    langid,
    manifest,
    mixing,
    near_dedup,
    neighbours,
    oracle,
    packing,
    quality,
    repeats,
    secrets,
    token_output,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    words = "<|im_end|><|im_start|>assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", words), (-1, 1, "assistant", words)], turns.schema)
    return chat_format.digest(chat_format.format_chats(turns.unionByName(probe)))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors, vectors.where("vec_id % 20 = 0"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return secrets.scan(docs, secrets.fit(docs)).drop("text_hash")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.find_repeats(_documents(spark, sf_dir)))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir), words=3, percent=85)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = langid.fit(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return langid.digest(langid.identify(_documents(spark, sf_dir), field))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(_documents(spark, sf_dir)))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_contamination(
        _documents(spark, sf_dir), _table(spark, sf_dir, "benchmark")).drop("text"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality.digest(quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels"))))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.pack_matrix(_documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.plan(_table(spark, sf_dir, "documents")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.digest(manifest.prove(_table(spark, sf_dir, "documents"), shown=manifest.tampered()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_chat_format, op2_nearest_neighbours, op3_secret_scan, op4_substring_dedup, op5_near_dedup,
    op6_language_id, op7_packing, op8_decontamination, op9_quality, op10_token_output,
    op11_source_divergence, op12_source_mixing, op13_merkle_manifest)}
QUERIES["pipeline"] = corpus_pipeline.run

#: Operators that are trained, approximate or pack tokens are tested against plain rules.
ORACLE: dict[str, str] = {"op1_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
  CAST(sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id""",
    **oracle.ORACLE,
    "op11_source_divergence": divergence.SQL, "op12_source_mixing": mixing.SQL, "op13_merkle_manifest": manifest.SQL}
