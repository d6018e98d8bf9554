"""WARC and WET archives: a scan over gzip members, distributed by file, and a sink that keeps record bytes.

``read_records`` lists files through Spark (``binaryFile``) so that any store works; one file is one task's unit, like
the archives' own chunking. Payloads are decoded in Spark SQL, bad bytes becoming U+FFFD.
"""

from __future__ import annotations

import gzip
import io
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions.langid import identify
from siftlake.functions.words import basename, decoded, held
from siftlake.session import durable

SCHEMA = "file string, pos bigint, rec_type string, headers map<string,string>, payload binary, raw binary"


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[str, dict[str, str], bytes, bytes]]:
    """``(rec_type, headers, payload, raw bytes)`` of each record; a cut-off record ends the scan."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        raw, headers = [line], {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            raw.append(line)
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip()] = value.strip()
        raw.append(line)
        low = {k.lower(): v for k, v in headers.items()}
        size = int(low.get("content-length", "0"))
        payload = stream.read(size)
        if len(payload) < size:
            return
        yield low.get("warc-type", ""), headers, payload, b"".join(raw) + payload + b"\r\n\r\n"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the (gzipped or plain) archives under ``path``, with their place in the file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("file", pa.string()), ("pos", pa.int64()), ("rec_type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("raw", pa.binary())])
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                data = content.as_py()
                stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
                rows = []
                for i, (t, h, p, r) in enumerate(parse(stream)):
                    rows.append({"file": name, "pos": i, "rec_type": t, "headers": list(h.items()), "payload": p, "raw": r})
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)

    return files.mapInArrow(work, SCHEMA)


def english_records(records: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Records that are no conversions, and conversions whose text is English with at least the threshold's score."""
    told = held(records, "_lang", F.when(F.col("rec_type") == "conversion", identify(decoded(F.col("payload")))))
    return told.where((F.col("rec_type") != "conversion") | ((F.col("_lang.label") == "en") & (F.col("_lang.score") >= threshold))).drop("_lang")


def write_records(records: DataFrame, path: str) -> DataFrame:
    """Record bytes in file order as archives under ``path``, one for each input file and of its base name, a gzip member a record.

    Tasks stream their records, so no archive is held in memory; each file is written under another name and renamed, so a
    repeated task replaces it. Two input files of one base name are an error. Gives ``(file, records)``.
    """
    named = records.select("file", F.regexp_replace(basename(F.col("file")), "[.]gz$", "").alias("base"), "pos", "raw")
    twice = named.groupBy("base").agg(F.min("file").alias("a"), F.max("file").alias("b")).where("a <> b").first()
    if twice:
        raise ValueError(f"{twice['a']} and {twice['b']} would be written to one file")
    uri = path if "://" in path else os.path.abspath(path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        now, out, n = None, None, 0

        def close() -> Iterator[pa.RecordBatch]:
            if now is not None:
                out.close()
                store.move(f"{root}/{now}.gz.{attempt}", f"{root}/{now}.gz")
                yield pa.RecordBatch.from_arrays([pa.array([f"{root}/{now}.gz"]), pa.array([n], pa.int64())], ["file", "records"])

        for b in batches:
            for base, raw in zip(b.column("base").to_pylist(), b.column("raw"), strict=True):
                if base != now:
                    yield from close()
                    now, n = base, 0
                    out = store.open_output_stream(f"{root}/{base}.gz.{attempt}", compression=None)
                out.write(gzip.compress(raw.as_py()))
                n += 1
        yield from close()

    dealt = named.select("base", "pos", "raw").repartition("base").sortWithinPartitions("base", "pos")
    return durable(dealt.mapInArrow(work, "file string, records bigint"), "archives")


def filter_archives(spark: SparkSession, source: str, target: str, threshold: float = 0.7) -> DataFrame:
    """Archives in, archives out: conversions that are not English with at least ``threshold`` go, all other records stay as they were.

    Gives ``(chunk, total_chars, skipped_chars, kept_percent)`` per input file.
    """
    records = read_records(spark, source)
    write_records(english_records(records, threshold), target)
    told = held(records.where("rec_type = 'conversion'").select("file", decoded(F.col("payload")).alias("text")), "_l", identify(F.col("text")))
    return kept_share(told.select(basename(F.col("file")).alias("chunk"), "text", F.coalesce((F.col("_l.label") == "en") & (F.col("_l.score") >= threshold), F.lit(False)).alias("keep")))


def html_responses(records: DataFrame) -> DataFrame:
    """``(file, pos, url, html)`` of response records: what follows the HTTP head of the payload, as bytes."""
    at = F.locate("\r\n\r\n", F.decode(F.col("payload"), "ISO-8859-1"))
    body = F.when(at > 0, F.substr("payload", at + 4)).otherwise(F.col("payload"))
    return records.where("rec_type = 'response'").select("file", "pos", F.col("headers")["WARC-Target-URI"].alias("url"), body.alias("html"))


def kept_share(conversions: DataFrame, keep: str = "keep", text: str = "text", chunk: str = "chunk") -> DataFrame:
    """Per chunk: code points in all, skipped, and the percentage kept (0 of nothing is 0)."""
    n = F.length(F.col(text)).cast("long")
    out = conversions.groupBy(chunk).agg(F.coalesce(F.sum(n), F.lit(0)).alias("total_chars"), F.coalesce(F.sum(F.when(~F.col(keep), n)), F.lit(0)).alias("skipped_chars"))
    return out.withColumn("kept_percent", F.coalesce(F.try_divide(100.0 * (F.col("total_chars") - F.col("skipped_chars")), F.col("total_chars")), F.lit(0.0)))
