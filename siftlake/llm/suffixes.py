"""Exact substring dedup over bytes through Burrows-Wheeler transforms.

Which 100-byte strings occur earlier is settled in four steps. (1) One anchor stands for every window (repeats.py);
anchors that occur once fall away. (2) Around each anchor left, the *context* is cut out, the bytes of all windows it
stands for, and sent to the bucket of the anchor, a context once a task. An anchor in very many documents, such as a
stock phrase, is dealt out by longer keys: eight neighbouring windows share 93 bytes, and these are the key. A key that still has
very many different contexts (the edge of a phrase) is dealt out window by window. (3) A bucket
joins its different contexts to one text, sorts the suffixes, takes the Burrows-Wheeler transform and derives the common
prefixes: intervals of suffixes are extended backwards, breadth first, so boundaries appear by increasing prefix length,
and the search stops at the minimum length. What has no boundary between it then shares ``span`` bytes. In each such
interval the earliest window stays. (4) The rest, as ranges, is cut from the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm import repeats as R
from siftlake.session import durable, durable_counted, release

BASE = 32
GROUP = 8
#: Bytes of contexts joined to one text at least, unless the task's last; larger only if one key alone has more.
BLOCK = 1 << 20
#: Different contexts of one key that a task gathers; a key with more is dealt out window by window.
CROWD = 4096

_BYTE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _units(text: bytes) -> np.ndarray:
    return _BYTE[np.frombuffer(text, np.uint8)]


def _whole(text: bytes) -> tuple[int, str]:
    return len(text), hashlib.sha256(text).hexdigest()


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``t`` (values over 0) sorted by their first ``depth`` values at least, equal ones in any order. By doubling."""
    n = len(t)
    rank = np.zeros(n + 8, np.int64)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = t
    key = np.zeros(n, np.uint64)
    for i in range(7):  # 9 bits a value
        key = (key << np.uint64(9)) | padded[i : n + i]
    width = 7
    while True:
        order = np.argsort(key)
        s = key[order]
        new = np.r_[False, s[1:] != s[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) + 1
        if width >= depth or new[1:].all():
            return order
        after = np.zeros(n, np.int64)
        after[: max(n - width, 0)] = rank[width:]
        key = (rank.astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
        width *= 2


def prefix_classes(t: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """``(sa, border)``: the sorted suffixes, and where a suffix shares fewer than ``span`` values with the one before it.

    Breadth-first backward extension over the transform: the queue of level l holds intervals of suffixes with a common
    prefix of l values; putting one value in front of it gives an interval of level l + 1, and the right end of that is
    a place where the common prefix is l values long, unless a shorter one has been found there before.
    """
    sa = suffix_array(t, span + 2)
    n = len(t)
    bwt = t[sa - 1]  # the text is taken as a ring: before the first suffix comes the last separator
    lf = np.empty(n, np.int64)
    by = np.argsort(bwt, kind="stable")
    lf[by] = np.arange(n)
    same = bwt[by][1:] == bwt[by][:-1]
    after = np.full(n, n, np.int64)  # the next place in the transform with the same value
    after[by[:-1][same]] = by[1:][same]
    before = np.full(n, -1, np.int64)
    before[by[1:][same]] = by[:-1][same]
    border = np.zeros(n + 1, bool)
    border[[0, n]] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(span):
        size = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        left, right = np.repeat(lo, size), np.repeat(hi, size)
        start = np.sort(lf[at[before[at] < left]])
        stop = np.sort(lf[at[after[at] >= right]]) + 1
        fresh = ~border[stop]
        lo, hi = start[fresh], stop[fresh]
        if not len(lo):
            break
        border[hi] = True
    return sa, border[:-1]


def later_windows(contexts: list[bytes], span: int) -> list[np.ndarray]:
    """For contexts in order of place: the starts in each of the windows that equal a window before them."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    t = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.uint16) + 2
    ends = np.cumsum(sizes + 1) - 1
    t[ends] = 1
    sa, border = prefix_classes(t, span)
    valid = np.ones(len(t), bool)
    for i in range(span):  # fewer than span bytes are left there
        at = ends - i
        valid[at[at >= 0]] = False
    class_of = np.cumsum(border)
    keep = valid[sa]
    pos, cls = sa[keep], class_of[keep]
    out = np.zeros(len(t), bool)
    if len(pos):
        head = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]])
        least = np.minimum.reduceat(pos, head)
        later = pos != np.repeat(least, np.diff(np.r_[head, len(pos)]))
        out[pos[later]] = True
    starts = ends - sizes
    hits = np.flatnonzero(out)
    owner = np.searchsorted(ends, hits)
    cut = np.searchsorted(owner, np.arange(len(contexts) + 1))
    return [hits[cut[i] : cut[i + 1]] - starts[i] for i in range(len(contexts))]


_FOUND = "doc_id bigint, th bigint, at bigint, upto bigint, key bigint, ctx binary"


def _contexts(span: int, base: int, group: int):
    """Contexts of the repeated anchors of each document, each once a task; further copies are ranges to remove."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        last = None
        for b in batches:
            rows: list[tuple] = []
            for doc, th, t, hs, hot in zip(b.column("doc_id").to_pylist(), b.column("th").to_pylist(), b.column("text"), b.column("hs"), b.column("hot"), strict=True):
                if (doc, th) == last:
                    continue
                last = doc, th
                text = t.as_py()
                h = R.extend(_units(text), 1, base)
                at, lo, hi = R.anchors(h, span - base + 1)
                known = hs.values.to_numpy().view(np.uint64)
                flags = np.array(hot.values.to_pylist(), bool)
                hit = np.isin(h[at], known)
                busy = np.isin(h[at], known[flags])
                gone: list[tuple[int, int]] = []
                for a, x, y, many in zip(at[hit].tolist(), lo[hit].tolist(), hi[hit].tolist(), busy[hit].tolist(), strict=True):
                    if many:
                        pieces = [(s, min(s + group - 1 - (s - a) % group, y)) for s in sorted({x, *range(x + (a - x) % group, y + 1, group)})]
                    else:
                        pieces = [(x, y)]
                    for s, e in pieces:
                        ctx = text[s : e + span]
                        code = hashlib.blake2b(ctx, digest_size=16).digest()
                        if code in seen:
                            gone.append((s, e + span))
                            continue
                        seen.add(code)
                        if many:
                            # windows at one place of the grid around the anchor share these bytes
                            top = s - (s - a) % group
                            key = int.from_bytes(hashlib.blake2b(text[top + group - 1 : top + span], digest_size=8).digest(), "little", signed=True)
                        else:
                            key = int(h[a].astype(np.int64))
                        rows.append((doc, th, s, e + span, key, ctx))
                if len(seen) > 2_000_000:  # only costs that a context is sent again
                    seen.clear()
                rows += [(doc, th, x, y, None, None) for x, y in _joined(gone)]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], pa.binary())], ["doc_id", "th", "at", "upto", "key", "ctx"])

    return work


def _windows(span: int):
    """Each context as its single windows, each under a key of its own: what differs parts, what is equal meets and need not be held."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, th, at, ctx in zip(*[b.column(c).to_pylist() for c in ("doc_id", "th", "at", "ctx")], strict=True):
                for i in range(len(ctx) - span + 1):
                    w = ctx[i : i + span]
                    out.append((doc, th, at + i, at + i + span, int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little", signed=True), w))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], pa.binary())], ["doc_id", "th", "at", "upto", "key", "ctx"])

    return work


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted(ranges):
        if out and x <= out[-1][1]:
            out[-1] = out[-1][0], max(y, out[-1][1])
        else:
            out.append((x, y))
    return out


def _buckets(span: int):
    """Ranges of the windows in a bucket that equal an earlier one. Rows come sorted by key, document and place."""

    def settle(held: list[tuple]) -> list[tuple[int, int, int, int]]:
        held.sort(key=lambda r: (r[0], r[2]))  # place in the corpus
        starts = later_windows([r[4] for r in held], span)
        out = []
        for (doc, th, at, _, _), s in zip(held, starts, strict=True):
            x, y = R.runs_of(s, span)
            out += [(doc, th, at + p, at + q) for p, q in zip(x.tolist(), y.tolist(), strict=True)]
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, key, group = 0, None, {}
        out: list[tuple[int, int, int, int]] = []

        def close() -> None:
            nonlocal size
            if len(group) > 1:
                held.extend(group.values())
                size += sum(len(c) for c in group)
            group.clear()

        for b in batches:
            for doc, th, at, upto, k, ctx in zip(*[b.column(c).to_pylist() for c in ("doc_id", "th", "at", "upto", "key", "ctx")], strict=True):
                if k != key:
                    close()
                    key = k
                    if size >= BLOCK:
                        out += settle(held)
                        held, size = [], 0
                if ctx in group:
                    out.append((doc, th, at, upto))
                else:
                    group[ctx] = (doc, th, at, upto, ctx)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "th", "at", "upto"])
                out = []
        close()
        if held:
            out = settle(held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "th", "at", "upto"])

    return work


def byte_repeats(docs: DataFrame, span: int = 100, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``(doc_id, th, n_bytes, n_removed, n_spans, kept_sha256, kept)``: the bytes left after earlier occurrences are kept only.

    A byte goes if a ``span``-byte string over it also starts earlier: in a document with a smaller id, or in the same
    document before. Matches do not cross documents and are judged on the input. ``kept`` (with ``keep_text``) is the
    text left, null where nothing was removed; characters are only dropped whole, so it is valid UTF-8.

    Null texts are empty. Texts shorter than ``span`` lose nothing. Rows that agree in id and text are one document; of
    different texts with one id, none is before the other only by chance of their hash. A null id ranks before all
    others. ``th`` is the XXH64 of the text. Anchors in over ``repeats.HOT`` documents, and keys of over ``CROWD`` contexts, are
    dealt out more finely; the result is the same. Extra columns are ignored; an empty table gives an empty result.
    """
    rows = R.prepared(docs, id_col, text_col)
    sk = R.sketch(rows, _units, _whole, span, min(BASE, span))
    all_ = durable(R.distinct_documents(sk), "documents")
    cand = durable(R.repeated_anchors(sk, all_, within=True), "candidates")
    release(sk)
    found = durable(rows.join(cand, ["doc_id", "th"]).sortWithinPartitions("doc_id", "th").mapInArrow(_contexts(span, min(BASE, span), GROUP), _FOUND), "contexts")
    wide = found.where("key is not null")
    # contexts at the edge of a stock passage share a key but differ in what follows: one for each document
    crowded, n = durable_counted(wide.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > CROWD).select("key"), "crowded")
    if n:
        single = wide.join(crowded, "key").select(wide.columns).mapInArrow(_windows(span), _FOUND)
        wide = wide.join(crowded, "key", "left_anti").select(wide.columns).unionByName(single)
    dealt = wide.repartition("key").sortWithinPartitions("key", "doc_id", "th", "at")
    ranges = dealt.mapInArrow(_buckets(span), "doc_id bigint, th bigint, at bigint, upto bigint").unionByName(found.where("key is null").select("doc_id", "th", "at", "upto"))
    ranges = durable(ranges, "ranges")
    release(found)
    grouped = ranges.groupBy("doc_id", "th").agg(F.collect_list("at").alias("starts"), F.collect_list("upto").alias("ends"))
    cut = rows.join(grouped, ["doc_id", "th"]).mapInArrow(_cut(keep_text), "doc_id bigint, th bigint, n_removed bigint, n_spans bigint, sha2 string, kept string").dropDuplicates(["doc_id", "th"])
    copy = ~F.col("first") & (F.col("n") >= span)
    out = all_.join(cut, ["doc_id", "th"], "left")
    return out.select(
        F.expr(f"nullif(doc_id, {R.NO_ID + 1}L - 1L)").alias("doc_id"),
        "th",
        F.col("n").alias("n_bytes"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha2", "sha")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )


def whole_characters(raw: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mask without characters of which some bytes would stay."""
    lead = (raw & 0xC0) != 0x80
    start = np.flatnonzero(lead)
    if not len(start):
        return mask
    gone = np.logical_and.reduceat(mask, start)
    return np.repeat(gone, np.diff(np.r_[start, len(raw)]))


def _cut(keep_text: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone, spans, shas, kept = [], [], [], []
            for t, s, e in zip(b.column("text"), b.column("starts"), b.column("ends"), strict=True):
                raw = np.frombuffer(t.as_py(), np.uint8)
                mask = R.removed(len(raw), s.values.to_numpy(), e.values.to_numpy())
                gone.append(int(mask.sum()))
                spans.append(int((np.diff(np.r_[0, mask.view(np.int8)]) == 1).sum()))
                shas.append(hashlib.sha256(raw[~mask].tobytes()).hexdigest())
                kept.append(raw[~whole_characters(raw, mask)].tobytes().decode("utf-8", "replace") if keep_text else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.string())], ["doc_id", "th", "n_removed", "n_spans", "sha2", "kept"])

    return work
