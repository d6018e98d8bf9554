"""Text files as documents, listings, and flat token files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions.urls import reference_part, urls_in
from siftlake.functions.words import basename, decoded_ignoring
from siftlake.session import durable


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, text)``: one row per whole file."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_listing(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """A header-less one-column CSV of paths, each put behind ``prefix``."""
    return spark.read.schema("wet_path string").csv(path).select(F.concat(F.lit(prefix), "wet_path").alias("wet_path"))


def first_path(spark: SparkSession, path: str, prefix: str = "") -> str | None:
    """The first path of a listing, in file order; None if it is empty."""
    row = read_listing(spark, path, prefix).first()
    return row and row[0]


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(value)``: the lines of text files, plain, gzip or bz2 by extension (bz2 is split among tasks); bad bytes are dropped."""
    raw = spark.read.format("text").load(path).select(F.col("value").cast("binary").alias("value"))
    return raw.select(decoded_ignoring(F.col("value")).alias("value"))


def dump_urls(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(url)``: the URLs in reference tags of the lines of wiki dumps, duplicates kept."""
    return read_lines(spark, path).select(F.explode(urls_in(reference_part(F.col("value")))).alias("url"))


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``(files, bytes)`` under ``path``; only the listing is read."""
    return spark.read.format("binaryFile").load(path).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def shard_names(listing_html: DataFrame, pattern: str) -> DataFrame:
    """The distinct names in an HTML listing, in order."""
    return listing_html.select(F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(0))).alias("name")).distinct().orderBy("name")


def write_document_files(docs: DataFrame, directory: str, name: str = "path", text: str = "text") -> int:
    """One file per row, named after the base of ``name``; two rows of one base name are an error, before anything is written.

    Rows come to the driver one partition at a time: for small results only.
    """
    twice = docs.groupBy(basename(F.col(name).cast("string")).alias("base")).agg(F.count("*").alias("n")).where("n > 1").first()
    if twice:
        raise ValueError(f"{twice['n']} documents would be written to {twice['base']}")
    os.makedirs(directory, exist_ok=True)
    n = 0
    for row in docs.select(name, text).toLocalIterator():
        with open(os.path.join(directory, os.path.basename(str(row[0]))), "w", encoding="utf-8", newline="") as f:
            f.write(row[1] or "")
        n += 1
    return n


def write_gzip_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").option("compression", "gzip").text(path)


def write_tokens(tokens: DataFrame, path: str, order: str = "doc_id", ids: str = "ids", parts: int | None = None) -> DataFrame:
    """Token arrays as flat files of little-endian 16-bit numbers, ``part-00000.bin`` and so on: joined in name order they are one array in the order of ``order``.

    Each task writes its file under another name and renames it, so a repeated task replaces it. Gives ``(file, tokens)``. A token that does not fit is an error.
    """
    keyed = tokens.select(F.col(order).alias("k"), F.col(ids).cast("array<int>").alias("ids"))
    ordered = (keyed.repartitionByRange(parts, "k") if parts else keyed.repartitionByRange("k")).sortWithinPartitions("k")
    uri = path if "://" in path else os.path.abspath(path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        own = TaskContext.get()
        name, n = f"{root}/part-{own.partitionId():05d}.bin", 0
        with store.open_output_stream(f"{name}.{own.taskAttemptId()}") as out:
            for b in batches:
                a = b.column("ids").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if len(a) and (a.min() < 0 or a.max() > 65535):
                    raise ValueError("a token does not fit in 16 bits")
                out.write(a.astype("<u2").tobytes())
                n += len(a)
        store.move(f"{name}.{own.taskAttemptId()}", name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "tokens"])

    return durable(ordered.mapInArrow(work, "file string, tokens bigint"), "token-files")


def read_token_files(spark: SparkSession, path: str, piece: int = 1 << 16) -> DataFrame:
    """Flat 16-bit files as ``(file, pos, tokens)``, at most ``piece`` tokens a row."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                a = np.frombuffer(content.as_py(), "<u2")
                for at in range(0, len(a), piece):
                    part = a[at : at + piece].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int64()), pa.array([part], pa.list_(pa.int32()))], ["file", "pos", "tokens"])

    return files.mapInArrow(work, "file string, pos bigint, tokens array<int>")
