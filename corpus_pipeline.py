"""From raw documents to packed sequences: quality rules, near-duplicates, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import decontaminate, packing, quality, simhash, suffixes
from siftlake.session import durable, ship, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents, and ``_row``: id and XXH64 of the text. A struct equals itself in joins, whatever is null in it."""
    text_hash = F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")
    return docs.select(*COLUMNS, F.struct("doc_id", text_hash).alias("_row"))


def _without(rows: DataFrame, bad: DataFrame) -> DataFrame:
    return rows.join(bad.select(F.col("doc_id").alias("_row")).distinct(), "_row", "left_anti").select(COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the perplexity bands keep. Each row is judged by its own text, also rows of one id or of none.

    Null, empty and wordless texts fail the rules. Repeated rows go or stay together. Very long texts are scored whole. An
    empty table gives an empty result; columns other than those of documents are left out, in this and all stages.
    """
    ship(spark)
    rows = _keyed(docs)
    return _without(rows, quality.quality(rows, id_col="_row").where("not kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group: exact Jaccard of five-word shingles at 0.8 or more, over links too.

    Null, empty and wordless texts are copies of each other. Of repeated rows, and of rows of one id in one group, one stays; a
    row without an id stays only if no other of its group has one. An empty table gives an empty result.
    """
    ship(spark)
    return simhash.without_near_copies(docs.select(COLUMNS)).select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 100 bytes or more that an earlier document, or the same before, has too.

    A row without an id comes before all others. Rows that agree in id and text are one document, so all of them keep the
    same text. Null texts stay null. A text may become empty; its row stays. An empty table gives an empty result.
    """
    ship(spark)
    cut = suffixes.byte_repeats(docs.select(COLUMNS), 100, keep_text=True).where("n_removed > 0").select(F.struct("doc_id", "th").alias("_row"), "kept")
    text = F.coalesce("kept", "text")
    return _keyed(docs).join(cut, "_row", "left").select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item. Each row is judged by its own text, also rows of one id or of none.

    Null and empty texts overlap with nothing and stay. Repeated rows go or stay together. An empty table gives an empty result.
    """
    ship(spark)
    rows = _keyed(docs)
    return _without(rows, decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), id_col="_row"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens, related documents together. Null and empty texts are the closing id alone; repeated rows are packed each."""
    ship(spark)
    return packing.pack_related(docs).drop("ids")


STAGES = [("quality", quality_rules), ("simhash", near_duplicates), ("suffix", repeated_passages), ("decontamination", decontamination), ("packing", packed)]

#: Fingerprints, perplexity and packing cannot be expressed in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = durable(docs, name)
    return docs
