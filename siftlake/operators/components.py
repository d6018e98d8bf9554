"""Connected components by alternating large-star and small-star rounds (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from siftlake.session import durable


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every vertex of ``edges``; ``component`` is the smallest id that can be reached.

    Neighbour lists are never gathered: each star step is a minimum per vertex (partly aggregated before the shuffle)
    joined back to the edges, so a hub costs an aggregate and an AQE-splittable join. Every round is written to the
    shared folder. Null ends are ignored; self loops keep their vertex; an empty input gives an empty result.
    """
    base = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    loops = base.select(F.col("u").alias("id"))
    now, seen = _written(base.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if not seen[0]:
            break
        large = _star(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), only_larger=True)
        before = seen
        now, seen = _written(_star(large, only_larger=False), "stars")
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component"))
    lone = loops.select("id", F.col("id").alias("component"))
    return ends.union(roots).union(lone).groupBy("id").agg(F.min("component").alias("component"))


def _star(pairs: DataFrame, only_larger: bool) -> DataFrame:
    """Link the larger (or the smaller) neighbours of each u, and u itself, to the least of its neighbourhood."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    both = pairs.join(least, "u")
    if only_larger:
        out = both.where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y"))
    else:
        out = both.select(F.col("v").alias("x"), F.col("m").alias("y")).union(least.select(F.col("u").alias("x"), F.col("m").alias("y")))
    return out.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()


def _written(df: DataFrame, name: str) -> tuple[DataFrame, tuple[int, int]]:
    """``df`` written, with the number of its rows and a checksum, both taken by the write itself."""
    seen = Observation()
    out = durable(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)).alias("s")), name)
    return out, (seen.get["n"], seen.get["s"] or 0)
