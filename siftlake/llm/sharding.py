"""Sharding by histogram sort: exact byte counts below probe keys, refined until the splitters fit, then one exchange.

The sort key of a row is 128 bits wide: XXH64 of its text, then XXH64 of its id. Equal texts are therefore neighbours,
and a splitter falls between two texts unless one text alone is heavier than the tolerance; then the id bits split
it. Each round sends at most ``(ranges - 1) * 256`` counts to the driver, whatever the input's size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.session import durable

STEP = 8
DEPTH = 128 // STEP


def shard_by_bytes(docs: DataFrame, shards: int = 16, fine: int = 16, tolerance: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as ``(id, size, text_crc32, law, shard, slot, grown_shard)`` under the law ``bytes``.

    ``shards * fine`` ranges of near equal bytes are found; every ``fine`` of them are one shard. ``slot`` counts a
    shard's rows in key order from 0 without a gap: rows are numbered inside each small range and moved by the number
    of rows in the ranges before it, so no task ever sorts a whole shard. ``tolerance`` is the error of a splitter as a
    part of one range.

    Null text counts as the empty text (size 1, crc 0). Repeated rows, ids included, are separate rows. A null id is
    hashed like any other value. An empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_h"),
        F.xxhash64(F.col(id_col), F.lit("id")).alias("_g"),
    )
    rows = durable(rows, "keys")  # numbers only; several rounds read them, and no executor's own disk is relied on
    ranges = shards * fine
    splitters = find_splitters(rows, ranges, tolerance)
    placed = rows.withColumn("_r", _range_of(splitters))
    counts = {r["_r"]: r["n"] for r in placed.groupBy("_r").agg(F.count("*").alias("n")).collect()}  # one row a range
    before, total = [], 0
    for r in range(ranges):
        total = 0 if r % fine == 0 else total
        before.append(total)
        total += counts.get(r, 0)
    place = F.array(*[F.lit(x).cast("long") for x in before])
    w = Window.partitionBy("_r").orderBy("_h", "_g", "doc_id")
    return placed.withColumn("_n", F.row_number().over(w)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.floor(F.col("_r") / fine).cast("int").alias("shard"),
        (F.get(place, F.col("_r")) + F.col("_n") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def find_splitters(rows: DataFrame, ranges: int, tolerance: float) -> list[tuple[int, ...]]:
    """Key prefixes (lists of bytes) below which 1/ranges, 2/ranges, ... of all bytes lie, within the tolerance."""
    total = rows.agg(F.sum("size").alias("s")).first()["s"] or 0
    if not total or ranges < 2:
        return []
    goal = {k: total * k / ranges for k in range(1, ranges)}
    slack = total / ranges * tolerance
    found: dict[int, tuple[int, ...]] = {}
    open_: dict[tuple[int, ...], tuple[float, list[int]]] = {(): (0.0, list(goal))}
    for level in range(DEPTH):
        if not open_:
            break
        heads = sorted(open_)
        hist = rows.select(_probe(heads, level)("_h", "_g").alias("at"), "size").where("at >= 0")
        sums = {divmod(r["at"], 256): r["s"] for r in hist.groupBy("at").agg(F.sum("size").alias("s")).collect()}
        nxt: dict[tuple[int, ...], tuple[float, list[int]]] = {}
        for p, head in enumerate(heads):
            below, waiting = open_[head]
            for d in range(256):
                here = sums.get((p, d), 0)
                still = []
                for k in waiting:
                    if goal[k] > below + here + slack and d < 255:
                        still.append(k)
                    elif abs(goal[k] - below) <= slack:
                        found[k] = (*head, d)
                    elif abs(goal[k] - below - here) <= slack or level == DEPTH - 1:
                        found[k] = _after((*head, d))
                    else:
                        nxt.setdefault((*head, d), (below, []))[1].append(k)
                waiting = still
                below += here
        open_ = nxt
    return [found[k] for k in range(1, ranges)]


def _after(prefix: tuple[int, ...]) -> tuple[int, ...]:
    """The least prefix above all keys that begin with this one."""
    p = list(prefix)
    while p and p[-1] == 255:
        p.pop()
    return (*p[:-1], p[-1] + 1) if p else (256,)


def _pair(prefix: tuple[int, ...]) -> tuple[int, int]:
    """The least key with this prefix as two unsigned longs; (256,) is beyond all keys."""
    if prefix == (256,):
        return (1 << 64) - 1, (1 << 64) - 1
    full = bytes([*prefix, *[0] * (DEPTH - len(prefix))])
    return int.from_bytes(full[:8], "big"), int.from_bytes(full[8:], "big")


def _unsigned(s: pd.Series) -> np.ndarray:
    return s.to_numpy().view(np.uint64)


def _rank(keys: list[tuple[int, ...]], h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """How many of the sorted keys are at or below each row's (h, g)."""
    pairs = [_pair(k) for k in keys]
    hi, lo = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.uint64)
    at, end = np.searchsorted(hi, h, "left"), np.searchsorted(hi, h, "right")
    tie = np.flatnonzero(at < end)
    for a in np.unique(at[tie]):  # at most one turn a key
        own = tie[at[tie] == a]
        at[own] += np.searchsorted(lo[a : end[own[0]]], g[own], "right")
    return at


def _probe(heads: list[tuple[int, ...]], level: int):
    """256 times the number of the open prefix that a row's key has, plus the next byte of the key; -1 if it has none."""

    @F.pandas_udf("int")
    def at(h: pd.Series, g: pd.Series) -> pd.Series:
        a, b = _unsigned(h), _unsigned(g)
        i = _rank(heads, a, b) - 1
        pairs = np.array([_pair(k) for k in heads], np.uint64).reshape(-1, 2)
        keep = [((1 << 64) - 1) ^ ((1 << (64 - STEP * n)) - 1) if n < 8 else (1 << 64) - 1 for n in (min(level, 8), max(level - 8, 0))]
        own = pairs[np.maximum(i, 0)]
        ok = (i >= 0) & ((a & np.uint64(keep[0])) == own[:, 0]) & ((b & np.uint64(keep[1])) == own[:, 1])
        digit = ((a if level < 8 else b) >> np.uint64(64 - STEP * (level % 8 + 1))) & np.uint64(255)
        return pd.Series(np.where(ok, i * 256 + digit.astype(np.int64), -1).astype(np.int32))

    return at


def _range_of(splitters: list[tuple[int, ...]]):
    @F.pandas_udf("int")
    def at(h: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series(_rank(splitters, _unsigned(h), _unsigned(g)).astype(np.int32))

    return at("_h", "_g")
