"""Calls over texts and over files, for those who have no DataFrame: each runs the operator of the same name."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions import gopher, langid, markup, pii
from siftlake.models import classifier
from siftlake.operators import dedup
from siftlake.session import ship
from siftlake.sources.files import write_document_files


def _one(spark: SparkSession, text: str, f: Callable[[Column], Column]):
    return spark.createDataFrame([(text,)], "text string").select(f(F.col("text")).alias("out")).first()["out"]


def extract_text(html: bytes) -> str | None:
    return markup.layout_text(html)


def identify_language(spark: SparkSession, text: str) -> tuple[str, float]:
    return tuple(_one(spark, text, langid.identify))


def mask_emails(spark: SparkSession, text: str) -> tuple[str, int]:
    return tuple(_one(spark, text, pii.mask_emails))


def mask_phones(spark: SparkSession, text: str) -> tuple[str, int]:
    return tuple(_one(spark, text, pii.mask_phones))


def mask_ips(spark: SparkSession, text: str) -> tuple[str, int]:
    return tuple(_one(spark, text, pii.mask_ips))


def classify_nsfw(spark: SparkSession, text: str) -> tuple[str, float]:
    return tuple(_one(spark, text, classifier.classify_nsfw))


def classify_toxic(spark: SparkSession, text: str) -> tuple[str, float]:
    return tuple(_one(spark, text, classifier.classify_toxic_words))


def passes_quality_rules(spark: SparkSession, text: str) -> bool:
    return gopher.with_metrics(spark.createDataFrame([(text,)], "text string")).first()["keep"]


def _read(spark: SparkSession, input_files: list[str | os.PathLike]) -> DataFrame:
    """``(doc_id, path, text)``: ids follow the order of paths as given."""
    ship(spark)
    names = [os.fspath(f) for f in input_files]
    ids = spark.createDataFrame([(i, f if "://" in f else os.path.abspath(f)) for i, f in enumerate(names)], "doc_id long, path string")
    read = spark.read.text(names, wholetext=True).select(F.regexp_replace(F.input_file_name(), "^file:/+", "/").alias("path"), F.col("value").alias("text"))
    return ids.join(read, "path", "left").select("doc_id", "path", F.coalesce("text", F.lit("")).alias("text"))


def exact_line_deduplication(spark: SparkSession, input_files: list[str | os.PathLike], output_directory: str | os.PathLike) -> int:
    """Every file again, under its base name, without the lines that occur more than once in all files. Gives the number of files."""
    docs = _read(spark, input_files)
    return write_document_files(docs.select("doc_id", "path").join(dedup.exact_line_dedup(docs), "doc_id"), os.fspath(output_directory))


def minhash_deduplication(spark: SparkSession, input_files: list[str | os.PathLike], num_hashes: int, num_bands: int, ngrams: int, jaccard_threshold: float, output_directory: str | os.PathLike) -> int:
    """One file of each group of near-duplicates, the first given, unchanged. Gives the number of files."""
    p = dedup.MinHash(num_hashes, num_bands, ngrams, jaccard_threshold)
    return write_document_files(dedup.minhash_dedup(_read(spark, input_files), p), os.fspath(output_directory))
