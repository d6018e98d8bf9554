"""Exact substring dedup over words by level-wise doubling.

Level 1 takes windows of half the length, one anchor per full window; those that occur in one document alone are
dropped. The windows around the survivors are extended to twice that length and counted again; at the full length the
windows that survive are the repeats. Between levels only hashes travel, and a task sends a hash once however many of
its documents hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm import repeats as R
from siftlake.session import durable, release


_CACHE = R.WordHashes()


def _units(text: bytes) -> np.ndarray:
    return _CACHE.of(text.split())


def _whole(text: bytes) -> tuple[int, str]:
    words = text.split()
    return len(words), hashlib.sha256(b" ".join(words)).hexdigest()


def word_substrings(docs: DataFrame, span: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, ranges)``: the words left after repeated ``span``-word windows are removed.

    Words are runs of other characters than ASCII white space. A word goes if it lies in a window whose words also
    begin, in the same order, somewhere in a document with a smaller id; windows are judged on the input. ``ranges`` are
    the removed half-open ranges of words.

    Null texts are empty. Texts of fewer than ``span`` words lose nothing. Rows that agree in id and text are one
    document; rows of one id with different texts are documents of the same rank. A null id ranks before all others.
    Extra columns are ignored; an empty table gives an empty result.
    """
    base = (span + 1) // 2
    rows = R.prepared(docs, id_col, text_col)
    sk = R.sketch(rows, _units, _whole, span, base)
    all_ = durable(R.distinct_documents(sk), "documents")
    cand = durable(R.repeated_anchors(sk, all_, within=False), "candidates")
    release(sk)
    found = durable(rows.join(cand, ["doc_id", "th"]).sortWithinPartitions("doc_id", "th").mapInArrow(_second_level(span, base), _FOUND), "windows")
    wide = found.where("h1 is not null")
    least = wide.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    least = durable(least, "least")  # see repeated_anchors: lets AQE split the join
    later = wide.join(least, ["h1", "h2"]).where("doc_id > least").select("doc_id", "th", "at", (F.col("at") + span).alias("upto"))
    ranges = found.where("h1 is null").select("doc_id", "th", "at", "upto").unionByName(later)
    ranges = durable(ranges, "ranges")
    release(found)
    grouped = ranges.groupBy("doc_id", "th").agg(F.collect_list("at").alias("starts"), F.collect_list("upto").alias("ends"))
    cut = rows.join(grouped, ["doc_id", "th"]).mapInArrow(_cut, "doc_id bigint, th bigint, n_removed bigint, kept string, ranges array<struct<at:bigint,upto:bigint>>").dropDuplicates(["doc_id", "th"])
    copy = ~F.col("first") & (F.col("n") >= span)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    whole_range = F.array(F.struct(F.lit(0).cast("long").alias("at"), F.col("n").alias("upto")))
    out = all_.join(cut, ["doc_id", "th"], "left")
    return out.select(
        F.expr(f"nullif(doc_id, {R.NO_ID + 1}L - 1L)").alias("doc_id"),
        F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, nothing).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(copy, whole_range).otherwise(F.coalesce("ranges", F.expr("cast(array() as array<struct<at:bigint,upto:bigint>>)"))).alias("ranges"),
    )


_FOUND = "doc_id bigint, th bigint, at bigint, upto bigint, h1 bigint, h2 bigint"


def _second_level(span: int, base: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # window hashes of documents with smaller ids in this task
        now: list[int] = []
        last = None
        for b in batches:
            parts: list[tuple[np.ndarray, ...]] = []
            for doc, th, t, hs in zip(b.column("doc_id").to_pylist(), b.column("th").to_pylist(), b.column("text"), b.column("hs"), strict=True):
                if (doc, th) == last:  # a repeated row
                    continue
                if last is not None and last[0] != doc:
                    seen.update(now)
                    now = []
                    if len(seen) > 4_000_000:  # only costs that a window is sent again
                        seen.clear()
                last = doc, th
                h = R.extend(_units(t.as_py()), 1, base)
                at, lo, hi = R.anchors(h, span - base + 1)
                hit = np.isin(h[at], hs.values.to_numpy().view(np.uint64))
                full, also = R.extend(h, base, span), R.extend(h ^ np.uint64(0x5851F42D4C957F2D), base, span)
                starts = np.concatenate([np.arange(x, y + 1) for x, y in zip(lo[hit].tolist(), hi[hit].tolist(), strict=True)] or [np.empty(0, np.int64)])
                if not len(starts):
                    continue
                codes = full[starts].tolist()
                old = np.fromiter(map(seen.__contains__, codes), bool, len(codes))
                gone = starts[old]  # this task saw the window in an earlier document
                x, y = R.runs_of(gone, span)
                fresh = starts[~old]
                now += codes
                n, m = len(x), len(fresh)
                mask = np.r_[np.ones(n, bool), np.zeros(m, bool)]
                parts.append((np.full(n + m, doc), np.full(n + m, th), np.r_[x, fresh], np.r_[y, fresh + span], mask, np.r_[np.zeros(n, np.uint64), full[fresh]], np.r_[np.zeros(n, np.uint64), also[fresh]]))
            if parts:
                doc, th, a, z, mask, h1, h2 = (np.concatenate(c) for c in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(th), pa.array(a), pa.array(z), pa.array(h1.view(np.int64), mask=mask), pa.array(h2.view(np.int64), mask=mask)], ["doc_id", "th", "at", "upto", "h1", "h2"])

    return work


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        gone, kept, lists = [], [], []
        for t, s, e in zip(b.column("text"), b.column("starts"), b.column("ends"), strict=True):
            words = t.as_py().split()
            mask = R.removed(len(words), s.values.to_numpy(), e.values.to_numpy())
            gone.append(int(mask.sum()))
            kept.append(hashlib.sha256(b" ".join([w for w, m in zip(words, mask.tolist(), strict=True) if not m])).hexdigest())
            edge = np.flatnonzero(np.diff(np.r_[0, mask.view(np.int8), 0]))
            lists.append([{"at": int(p), "upto": int(q)} for p, q in edge.reshape(-1, 2)])
        kind = pa.list_(pa.struct([("at", pa.int64()), ("upto", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(lists, kind)], ["doc_id", "th", "n_removed", "kept", "ranges"])
