"""The ten queries over the driver's tables, and the SQL that some of them have."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftlake.llm import chat, decontaminate, html, licenses, oracle, packing, quality, sharding, simhash, substrings, suffixes
from siftlake.session import table


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.byte_repeats(table(spark, sf_dir, "documents"), 100).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_related(table(spark, sf_dir, "documents")).drop("ids")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.word_substrings(table(spark, sf_dir, "documents"), 50).drop("ranges")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_paths(chat.reply_paths(chat.chained(rows))))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).select("doc_id", *quality.NAMES, "base_failed", "kept")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html, op2_suffix, op3_packing, op4_substrings, op5_chat, op6_licenses, op7_simhash, op8_decontamination, op9_quality, op10_sharding)}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
