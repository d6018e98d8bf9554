"""Sampling, chunking, windows over token arrays, and schedule arithmetic."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def seeded_order(seed: int, key: str) -> Column:
    """A fixed pseudo-random order: the MD5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """``n`` rows without replacement in a shuffled order; a top-n, so no task sorts all rows."""
    return df.orderBy(seeded_order(seed, key), key).limit(n)


def chunked(df: DataFrame, size: int, order: str, spread: int = 256) -> DataFrame:
    """``df`` with ``pos`` (from 0, in ``order``, a numeric unique key) and ``chunk`` = pos // size.

    Rows fall into at most ``spread`` ranges of the key, are numbered inside a range and moved by the counts of the ranges
    before it, so no task sorts more than a range. Only cuts and counts, ``spread`` numbers each, come to the driver.
    """
    cuts = df.select(F.percentile_approx(order, [i / spread for i in range(1, spread)], 10_000).alias("c")).first()["c"] or []
    edges = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<long>")
    ranged = df.withColumn("_r", F.size(F.filter(edges, lambda x: x < F.col(order))))
    counts = {r["_r"]: r["n"] for r in ranged.groupBy("_r").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for r in range(len(cuts) + 1):
        before.append(total)
        total += counts.get(r, 0)
    i = F.row_number().over(Window.partitionBy("_r").orderBy(order))
    pos = (F.get(F.array(*[F.lit(x).cast("long") for x in before]), F.col("_r")) + i - 1).cast("long")
    out = ranged.withColumn("pos", pos).drop("_r")
    return out.withColumn("chunk", F.floor(F.col("pos") / size).cast("long"))


def training_windows(tokens: DataFrame, ctx: int, stride: int, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, start, x, y)``: windows of ``ctx`` tokens every ``stride`` starts, y shifted by one; starts in [0, len - ctx)."""
    n = F.size(ids) - ctx
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return tokens.select(key, ids, F.explode(starts).alias("start")).select(key, "start", F.slice(ids, F.col("start") + 1, ctx).alias("x"), F.slice(ids, F.col("start") + 2, ctx).alias("y"))


def random_windows(tokens: DataFrame, ctx: int, per_row: int, seed: int, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``per_row`` windows of each long enough array, starts drawn with replacement from a hash of seed, key and number."""
    n = F.size(ids) - ctx
    drawn = tokens.where(n > 0).select(key, ids, F.explode(F.sequence(F.lit(0), F.lit(per_row - 1))).alias("draw"))
    drawn_bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.col("draw").cast("string"))), 1, 12), 16, 10).cast("long")
    start = F.pmod(drawn_bits, n.cast("long")).cast("int")
    return drawn.select(key, "draw", ids, start.alias("start")).select(key, "draw", "start", F.slice(ids, F.col("start") + 1, ctx).alias("x"), F.slice(ids, F.col("start") + 2, ctx).alias("y"))


def last_tokens(ids: str, ctx: int) -> Column:
    return F.slice(ids, F.greatest(F.size(ids) - ctx, F.lit(0)) + 1, ctx)


def until_sentinel(ids: str, eos: int) -> Column:
    """The tokens before the first ``eos``; all of them without one."""
    at = F.array_position(ids, eos).cast("int")
    return F.when(at > 0, F.slice(ids, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(F.col(ids))


def top_k(df: DataFrame, group: list[str], by: str, k: int, tie: str) -> DataFrame:
    """The k largest per group; the window is a rank limit, which Spark applies before the shuffle too."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(by), tie))).where(F.col("rank") <= k)


def cosine_rate(it: Column, top: float, low: float, warm: int, cycle: int) -> Column:
    """Linear warm-up, half a cosine down to ``low`` at ``cycle``, then ``low``."""
    part = (it - warm) / float(max(cycle - warm, 1))
    return F.when(it < warm, top * it / float(max(warm, 1))).when(it > cycle, F.lit(low)).otherwise(low + 0.5 * (1 + F.cos(F.pi() * part)) * (top - low))


def padded_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """``%05d-name`` by position."""
    return chunked(df, 1, order).withColumn("link", F.format_string("%05d-%s", "pos", name))


def every_kth(df: DataFrame, k: int, order: str) -> DataFrame:
    """The rows whose position in ``order`` is a multiple of ``k``, with ``pos``."""
    return chunked(df, k, order).where(F.col("pos") % k == 0).drop("chunk")


def weighted_sample(df: DataFrame, n: int, seed: int, key: str, weight: str) -> DataFrame:
    """``n`` rows without replacement, drawn with probabilities in proportion to ``weight``: the least of exponential waiting times. Weights of 0 or null are never drawn."""
    u = (F.conv(F.substring(seeded_order(seed, key), 1, 12), 16, 10).cast("double") + 1) / float((1 << 48) + 1)
    return df.where(F.col(weight) > 0).orderBy(-F.log(u) / F.col(weight), key).limit(n)


def softmax(values: str | Column) -> Column:
    """Probabilities of an array of scores, shifted by the largest one."""
    x = F.col(values) if isinstance(values, str) else values
    made = F.transform(F.array(F.struct(F.transform(x, lambda v: F.exp(v - F.array_max(x))).alias("e"))), lambda s: F.transform(s["e"], lambda v: v / F.aggregate(s["e"], F.lit(0.0), lambda a, b: a + b)))
    return made[0]


def rms(values: str | Column) -> Column:
    """The root of the mean square of an array."""
    x = F.col(values) if isinstance(values, str) else values
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x))


@F.pandas_udf(DoubleType())
def mad(values: pd.Series) -> float:
    """Median distance from the median: an aggregate of one's own. A group is one value here, so groups must fit in memory; hot ones belong to ``percentile_approx``."""
    v = values.dropna()
    return float((v - v.median()).abs().median()) if len(v) else None
