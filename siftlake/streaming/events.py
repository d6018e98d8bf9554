"""Row-local operators on streams, and windowed counts over events (an extension; the batch engine is the product)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.functions.gopher import with_metrics
from siftlake.functions.pii import mask_all


def clean_stream(docs: DataFrame) -> DataFrame:
    """Masked texts of the documents that the quality rules keep; works on a batch or a stream."""
    return with_metrics(docs).where("keep").select("doc_id", mask_all(F.col("text")).alias("text"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and their value per type and tumbling window, with a watermark."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return ts.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
