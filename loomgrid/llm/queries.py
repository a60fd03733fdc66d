"""Queries of the ten corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.llm import mixing

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs).select("doc_id", "source", "lang", "pool", "copy")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.llm import substring_dedup

    return substring_dedup.report_repeats(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.llm import line_dedup

    return line_dedup.drop_repeated_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.llm import near_dedup

    return near_dedup.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "group_id", "copies", "keep")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds media, so each page becomes a container, its HTML cut into samples."""
    from loomgrid.llm import media

    out = media.media_tracks(media.containers(table(spark, sf_dir, "pages"), "page_id", "html"))
    return out.withColumnRenamed("id", "page_id").withColumn("keyframes", F.to_json("keyframes"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.llm import decontaminate

    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.llm import brown_lm

    return brown_lm.train_and_score(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.llm import secret_scan

    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.llm import langid

    docs = table(spark, sf_dir, "documents")
    out = langid.label_languages(docs, langid.train(docs))
    return out.withColumn("spans", F.to_json("spans"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.llm import shard

    return shard.shard(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_substring_dedup, op3_line_dedup, op4_near_dedup, op5_media, op6_decontamination, op7_lm_scoring, op8_secret_scan, op9_language_id, op10_sharding, pipeline)}


#: What the container of a page holds: samples of 1024 bytes of its HTML, at 30 a second, of which
#: every 12th is a keyframe, behind 32 bytes of boxes.
OP5_SQL = """
WITH sized AS (SELECT page_id, octet_length(encode(html)) AS n, (octet_length(encode(html)) + 1023) // 1024 AS k FROM pages)
SELECT page_id, CAST(CASE WHEN n IS NOT NULL THEN 1 END AS INTEGER) AS track_id, CASE WHEN n IS NOT NULL THEN 'vide' END AS handler,
  CASE WHEN n IS NOT NULL THEN 'avc1' END AS codec, CAST(CASE WHEN n IS NOT NULL THEN 90000 END AS BIGINT) AS timescale,
  CAST(k * 3000 * 1000 // 90000 AS BIGINT) AS duration_ms, CAST(k AS INTEGER) AS n_samples, CAST(n AS BIGINT) AS n_bytes,
  CASE WHEN n IS NOT NULL THEN CAST(to_json(list_transform(range(0, k, 12), lambda i:
    {'sample': i + 1, 'time_ms': i * 3000 * 1000 // 90000, 'offset': 32 + i * 1024, 'size': least(1024, n - i * 1024)})) AS VARCHAR) END AS keyframes,
  CASE WHEN n IS NULL THEN 'null' END AS error
FROM sized
"""


def oracle_sql() -> dict[str, str]:
    """Of the queries that SQL can express. The others hash, train, sample or solve a flow; their
    tests hold them against brute force."""
    return {"op5_media": OP5_SQL}
