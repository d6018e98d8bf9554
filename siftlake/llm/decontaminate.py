"""Benchmark decontamination by spaced seeds. Main path: Spark SQL functions only.

A seed mask picks some of the words of a short span and ignores the others, so a hash over the picked words survives a
replaced word at an ignored place. The two masks below together hit every 13-word overlap with at most two replaced
words (all 92 patterns were tried), so the join on seed hashes loses no overlap that the verification would accept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.session import durable_counted

#: At most two masks may be joined at once.
MASKS = ("11101011", "110100111")
SHORT_MASK = "11111"
WINDOW, EQUAL, SHORTEST = 13, 11, 5
#: Above so many seeds of the benchmark the join is shuffled instead of broadcast (a seed takes about 100 bytes there).
BROADCAST_SEEDS = 500_000
#: Above so many hits (some 50 bytes each) the second pass over the documents with hits is a shuffled join instead of a broadcast one.
BROADCAST_HITS = 500_000


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _seeds(hashes: str, mask: str) -> Column:
    """The seed hash at each position of the word hashes in column ``hashes``."""
    picks = [i for i, c in enumerate(mask) if c == "1"]
    n = F.greatest(F.size(hashes) - len(mask) + 1, F.lit(0))
    return F.transform(F.slice(hashes, F.lit(1), n), lambda x, i: F.xxhash64(F.lit(mask), x, *[F.get(F.col(hashes), i + p) for p in picks[1:]]))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, matched, doc_start)``: the pairs of documents and benchmark items that overlap.

    A pair overlaps if, at one alignment of the item with the document, 13 consecutive words of the item agree with the
    document in at least 11 places (substitutions only). Items of 5 to 12 words must occur as a whole; shorter ones are
    no evidence and never match. ``matched`` is the most agreeing words at one such alignment, ``doc_start`` the
    document word at which the item begins there (the smallest; negative if the item's head is cut off).

    Null and empty texts on either side match nothing. Repeated documents give equal rows once per id. Extra columns
    are ignored. An empty table on either side gives an empty result. Whole texts are read.

    Two sides are broadcast only after their rows are counted: the benchmark's seeds (``BROADCAST_SEEDS``) and the hits
    (``BROADCAST_HITS``); beyond that the joins are shuffled, with the same result.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text)).alias("_w")).where("item_id is not null").select("item_id", F.transform("_w", lambda w: F.xxhash64(w)).alias("_ih")).where(F.size("_ih") >= SHORTEST)
    row = items.agg(F.sum(F.size("_ih")).alias("n"), F.sum((F.size("_ih") < WINDOW).cast("int")).alias("short")).first()
    small = (row["n"] or 0) * (len(MASKS) + 1) <= BROADCAST_SEEDS
    side = F.broadcast if small else (lambda d: d)
    hashed = docs.select(F.col(id_col).alias("doc_id"), word_hashes(F.col(text_col)).alias("_dh"))
    hits = _hits(hashed, items.where(F.size("_ih") >= WINDOW), MASKS, side)
    if row["short"]:
        hits = hits.unionByName(_hits(hashed, items.where(F.size("_ih") < WINDOW), (SHORT_MASK,), side))
    # seeds travel without their document; the words around the hits are taken in a second pass over documents with hits
    hits, found = durable_counted(hits.distinct(), "hits")
    per_doc = hits.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "_d", "_n")).alias("_hits")).withColumnRenamed("doc_id", "_hd")
    few = F.broadcast if found <= BROADCAST_HITS else (lambda d: d)  # else the texts are shuffled to them
    again = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).join(few(per_doc), F.col("doc_id").eqNullSafe(F.col("_hd"))).select("doc_id", "_hits", word_hashes(F.col("_text")).alias("_dh"))
    cut = F.transform("_hits", lambda h: F.struct(h["item_id"].alias("item_id"), h["_d"].alias("_d"), F.slice(F.col("_dh"), F.greatest(h["_d"], F.lit(0)) + 1, h["_n"]).alias("_dw")))
    hits = again.select("doc_id", F.explode_outer(cut).alias("h")).select("doc_id", "h.item_id", "h._d", "h._dw").join(side(items), "item_id")
    agree = F.filter(F.sequence(F.lit(0), F.size("_ih") - 1), lambda j: F.get(F.col("_dw"), j - F.greatest(-F.col("_d"), F.lit(0))) == F.get(F.col("_ih"), j))
    # explode() of one array: the optimiser cannot repeat the filter inside the lambda functions below
    seen = hits.withColumn("_at", F.explode_outer(F.array(agree)))
    full = F.exists(F.transform("_at", lambda x, i: F.get(F.col("_at"), i + (EQUAL - 1)) - x), lambda v: v <= WINDOW - 1)
    ok = F.when(F.size("_ih") >= WINDOW, full).otherwise(F.size("_at") == F.size("_ih"))
    best = seen.where(ok).groupBy("doc_id", "item_id").agg(F.max(F.size("_at")).cast("long").alias("matched"), F.min_by("_d", F.struct(-F.size("_at"), F.col("_d"))).cast("long").alias("doc_start"))
    return best.select("doc_id", "item_id", "matched", "doc_start")


def word_hashes(text: Column) -> Column:
    """XXH64 of every word. An empty string before the first word only moves positions, so it is not filtered out."""
    return F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.xxhash64(w))


def _hits(hashed: DataFrame, items: DataFrame, masks: tuple[str, ...], side) -> DataFrame:
    """``(doc_id, item_id, _d, _n)``: seed hits; ``_d`` is where the item of ``_n`` words would begin in the document.

    Outer explodes keep the optimiser from inferring a size filter that would repeat the hashing, word by word.
    """
    seeds = None
    for mask in masks:
        part = items.select("item_id", F.size("_ih").alias("_n"), F.posexplode_outer(_seeds("_ih", mask)).alias("_j", "_seed"))
        seeds = part if seeds is None else seeds.unionByName(part)
    both = hashed.select("doc_id", F.greatest(F.size("_dh") - len(masks[0]) + 1, F.lit(0)).alias("_n0"), F.concat(*[_seeds("_dh", m) for m in masks]).alias("_s"))
    every = both.select("doc_id", "_n0", F.posexplode_outer("_s").alias("_p", "_seed"))  # a seed hash holds its mask, so only the places need care
    i = F.when(F.col("_p") >= F.col("_n0"), F.col("_p") - F.col("_n0")).otherwise(F.col("_p"))
    return every.join(side(seeds), "_seed").select("doc_id", "item_id", (i - F.col("_j")).alias("_d"), "_n")


def sql() -> str:
    """Brute force in DuckDB: all alignments with a common word, no seeds."""
    return rf"""WITH d AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+') AS w FROM documents)),
b AS (SELECT item_id, len(w) AS n, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS j FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark)),
m AS (SELECT doc_id, item_id, n, i - j AS s, list(j ORDER BY j) AS js FROM d JOIN b USING (w) GROUP BY ALL HAVING count(*) >= least({EQUAL}, n)),
ok AS (SELECT doc_id, item_id, s, len(js) AS k FROM m WHERE n >= {SHORTEST} AND CASE WHEN n < {WINDOW} THEN len(js) = n ELSE len(list_filter(range(1, len(js) - {EQUAL - 2}), lambda q: js[q + {EQUAL - 1}] - js[q] <= {WINDOW - 1})) > 0 END)
SELECT doc_id, item_id, max(k)::BIGINT AS matched, arg_min(s, (-k, s))::BIGINT AS doc_start FROM ok GROUP BY doc_id, item_id"""
