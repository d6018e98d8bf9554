"""What the two exact substring operators share: window hashes by doubling, anchors, and the search for repeated ones.

A *window* is ``span`` consecutive units (bytes or words). Every window has one *anchor*: of the ``base``-unit pieces in
it the one with the least hash, the leftmost of equals. Equal windows have equal anchors at the same place, so a window
can only be repeated if its anchor is; about two anchors per ``span - base + 1`` units suffice for all windows, which
is what makes the first level of the search small. Anchors that occur once in the corpus fall away there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.session import durable

_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_CHUNK = 1 << 19
NO_ID = -(1 << 63)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes; the order matters."""
    out = a * _C1
    out += b
    out ^= out >> np.uint64(31)
    out *= _C2
    out ^= out >> np.uint64(29)
    out *= _C3
    out ^= out >> np.uint64(32)
    return out


class WordHashes(dict):
    """XXH3 of words, remembered; bounded by starting anew."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def extend(h: np.ndarray, width: int, to: int) -> np.ndarray:
    """Hashes of ``to``-unit windows from those of ``width`` units: doubled while possible, the last step overlapping."""
    while width < to:
        step = min(width, to - width)
        if len(h) <= step:
            return h[:0]
        h = mix(h[: len(h) - step], h[step:])
        width += step
    return h


def anchors(h: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(at, first, last)``: anchor positions in ``h`` and the first and last start of the windows that each stands for.

    ``windows``: how many entries of ``h`` lie in one window.
    """
    n = len(h) - windows + 1
    if n <= 0:
        e = np.empty(0, np.int64)
        return e, e, e
    out = []
    for lo in range(0, n, _CHUNK):
        hi = min(lo + _CHUNK, n)
        key = h[lo : hi + windows - 1] & ~np.uint64((1 << 20) - 1)
        key |= np.arange(len(key), dtype=np.uint64)
        width = 1
        while width < windows:
            step = min(width, windows - width)
            key = np.minimum(key[: len(key) - step], key[step:])
            width += step
        out.append((key & np.uint64((1 << 20) - 1)).astype(np.int64) + lo)
    at = np.concatenate(out)
    turn = np.flatnonzero(at[1:] != at[:-1]) + 1
    first = np.r_[0, turn]
    return at[first], first, np.r_[turn - 1, n - 1]


Units = Callable[[bytes], np.ndarray]


def prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, text): null text as empty, a null id as the least long, th the XXH64 that tells texts of one id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))


def sketch(docs: DataFrame, units: Units, whole: Callable[[bytes], tuple[int, str]], span: int, base: int) -> DataFrame:
    """``(doc_id, th, digest, n, sha, anchors, many)``, once per document and text.

    ``whole`` gives the number of units and the digest of the text as a whole; ``anchors`` has the distinct anchor
    hashes and ``many`` whether each occurs more than once in the document. Repeated rows fall together here.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digest, n, sha, lists, flags = [], [], [], [], []
            for t in b.column("text"):
                text = t.as_py()
                size, total = whole(text)
                digest.append(hashlib.blake2b(text, digest_size=16).digest())
                n.append(size)
                sha.append(total)
                h = extend(units(text), 1, base)
                found, times = np.unique(h[anchors(h, span - base + 1)[0]], return_counts=True)
                lists.append(found.view(np.int64))
                flags.append(times > 1)
            at = pa.array(np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32))
            values = np.concatenate(lists) if lists else np.empty(0, np.int64)
            marks = np.concatenate(flags) if flags else np.empty(0, bool)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.ListArray.from_arrays(at, pa.array(values)), pa.ListArray.from_arrays(at, pa.array(marks))], ["doc_id", "th", "digest", "n", "sha", "anchors", "many"])

    made = docs.mapInArrow(work, "doc_id bigint, th bigint, digest binary, n bigint, sha string, anchors array<bigint>, many array<boolean>")
    return durable(made, "sketch")


def distinct_documents(sk: DataFrame) -> DataFrame:
    """``(doc_id, th, digest, n, sha, first)``, one row a document; ``first``: no smaller id has the very same text."""
    # copies of one text may be a third of all rows: a join that AQE can split, as both sides are exchanged for it
    heads = durable(sk.groupBy("digest").agg(F.min("doc_id").alias("least")), "heads")
    return sk.select("doc_id", "th", "digest", "n", "sha").join(heads, "digest").select("doc_id", "th", "digest", "n", "sha", (F.col("doc_id") == F.col("least")).alias("first")).dropDuplicates(["doc_id", "th"])


def repeated_anchors(sk: DataFrame, first: DataFrame, within: bool) -> DataFrame:
    """``(doc_id, th, hs, hot)``: for documents that hold repeated anchors, these anchors, and which are in very many documents.

    ``within``: an anchor twice in one document counts as repeated. ``first``: the documents that take part.
    """
    own = sk.join(first.where("first").select("doc_id", "th"), ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"])
    one = own.select("doc_id", "th", F.explode(F.arrays_zip("anchors", "many")).alias("a")).select(F.col("a.anchors").alias("h"), "doc_id", "th", F.col("a.many").alias("m"))
    times = one.groupBy("h").agg(F.sum(F.when(F.col("m") & F.lit(within), 2).otherwise(1)).alias("k")).where("k > 1")
    times = durable(times, "times")  # an aggregate right below the join would keep AQE from splitting a hot anchor
    kept = one.join(times, "h").select("doc_id", "th", F.col("h"), (F.col("k") > HOT).alias("hot"))
    return kept.groupBy("doc_id", "th").agg(F.collect_list("h").alias("hs"), F.collect_list("hot").alias("hot"))


#: An anchor in more documents than this is dealt out by longer keys, see suffixes.py.
HOT = 512


def removed(mask_len: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mask of the units in the given half-open ranges."""
    d = np.zeros(mask_len + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0


def runs_of(starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted window starts as half-open ranges of units, neighbours joined."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) > span)
    return starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]] + span
