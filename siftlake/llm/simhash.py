"""SimHash near-duplicates through vantage-point trees.

A fingerprint has 64 bits, the majority of its shingles' XXH64. Texts with one fingerprint are one class from the start.
The distinct fingerprints are searched by vantage-point trees: a tree parts its fingerprints by their Hamming distance
from a vantage point, down to leaves of ``leaf``, and a query goes only into the sides that the triangle inequality leaves
open: into the inside (distance at most ``mu``) if it is itself at most ``mu + radius`` from the point, into the outside
if it is more than ``mu - radius`` from it. The pairs all come from these leaves.

One tree over everything would prune next to nothing: distances between unrelated fingerprints crowd around 32 bits, four
to either side, so most queries would visit most leaves. Fingerprints are therefore dealt to shards first, by blocks of
bits: linked fingerprints differ in at most ``radius`` bits, so one of ``radius + 1`` blocks does not differ at all. As many
bits of a block are used as give shards of about ``cell`` fingerprints, none at all for small inputs. A shard too large for one task (``most``) is parted around
vantage points in the same way, by joins; what is near the boundary goes to both sides, as a query on the other one. Where
such a cut would only copy (everything lies near the boundary), the shard is dealt out in tiles, pairs of sub-shards, each of bounded
size: every pair still meets.

A task links what it sees by a spanning forest, never by all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm import repeats as R
from siftlake.operators.components import connected_components
from siftlake.session import durable, durable_counted, release

SEED = 42
_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, width: int = 3) -> int:
    """The SimHash of UTF-8 bytes: A-Z lower-cased, words cut at ASCII white space, ``width``-word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    stops = (ends - 1)[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * ones > len(h)).astype(np.uint64) << _BITS).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed long; null and wordless texts have 0."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py() or b"", width) for t in b.column("t")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return slim.mapInArrow(work, "doc_id bigint, fp bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, cell: int = 256) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: one row per document; ``component_id`` is the smallest id it is linked to, through others too.

    Null and empty texts have the fingerprint zero and are linked like any other. A text of fewer than ``width`` words
    has its whole sequence as one shingle. Repeated rows share a class; a null id is kept and never names a component
    while another id can. An empty table gives an empty result. Extra columns are ignored.
    """
    fps = durable(fingerprints(docs, id_col, text_col, width), "fps")
    classes = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    links = link_fingerprints(classes.select("fp"), radius, cell)
    comp = connected_components(links).withColumnRenamed("id", "fp")
    named = classes.join(comp, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("c"))
    least = durable(named.groupBy("c").agg(F.min("rep").alias("component_id")), "least")
    root = named.join(least, "c").select("fp", "component_id")
    # copies of one text may be a third of all rows: AQE splits that side of the join
    return fps.join(root, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def link_fingerprints(fps: DataFrame, radius: int = 3, cell: int = 256, leaf: int = 32, most: int = 1 << 14) -> DataFrame:
    """``(a, b)``: a spanning forest of the graph of distinct fingerprints at most ``radius`` bits apart.

    ``cell``: the size of shards that block bits are chosen for; ``most``: fingerprints that one task searches at once. Both
    only move work, the components are the same for all values. ``fps`` must hold each fingerprint once.
    """
    blocks = radius + 1
    wide = 64 // blocks
    n = fps.count()
    bits = min(max(-(-n // cell) - 1, 0).bit_length(), wide)
    if bits:
        cuts = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.shiftleft("fp", 64 - wide * i - bits), 64 - bits).alias("value")) for i in range(blocks)]
    else:
        cuts = [F.struct(F.lit(0).alias("block"), F.lit(0).cast("long").alias("value"))]
    shards = fps.select("fp", F.explode(F.array(*cuts)).alias("k")).select(F.xxhash64("k.block", "k.value").alias("shard"), "fp", F.lit(True).alias("own"))
    shards = _split_large(shards, radius, most)
    part = shards.repartition("shard").sortWithinPartitions("shard", F.desc("own"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fp, own in _whole_groups(batches):
            a, b = _link_sorted(keys, fp, own, radius, leaf)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return durable(part.mapInArrow(work, "a bigint, b bigint").distinct(), "links")


def _split_large(shards: DataFrame, radius: int, most: int) -> DataFrame:
    """Part shards of more than ``most`` fingerprints around vantage points, or into tiles where that would only copy, until none is left."""
    dist = F.bit_count(F.col("fp").bitwiseXOR(F.col("vp")))
    written = None
    while True:
        large, found = durable_counted(shards.groupBy("shard").agg(F.count("*").alias("n"), F.min_by("fp", F.xxhash64("fp", "shard")).alias("vp")).where(F.col("n") > most), "large")
        if not found:
            return shards
        small = shards.join(large, "shard", "left_anti")
        far = shards.join(large, "shard").withColumn("d", dist)
        # 65 possible distances: a histogram gives the median and what a cut there would send to either side
        hist = far.groupBy("shard", "n", "d").agg(F.count("*").alias("c"))
        mid = hist.groupBy("shard", "n").agg(F.sort_array(F.collect_list(F.struct("d", "c"))).alias("h"))
        upto = lambda at: F.aggregate("h", F.lit(0).cast("long"), lambda s, x: s + F.when(x["d"] <= at, x["c"]).otherwise(0))
        mid = mid.withColumn("mu", F.expr("filter(transform(h, (x, i) -> struct(x.d as d, aggregate(slice(h, 1, i + 1), 0L, (s, y) -> s + y.c) as upto)), x -> 2 * x.upto >= n)[0].d"))
        mid = mid.withColumns({"inside": upto(F.col("mu") + radius), "outside": F.col("n") - upto(F.col("mu") - radius)})
        gains = (F.greatest("inside", "outside") <= 0.8 * F.col("n")) & (F.col("inside") + F.col("outside") <= 1.6 * F.col("n"))
        mid = durable(mid.select("shard", "mu", gains.alias("gains"), F.ceil(F.col("n") / F.lit(most // 2)).cast("int").alias("g")), "cuts")
        at = far.join(mid, "shard")
        inside = F.col("d") <= F.col("mu")
        sides = F.array(
            F.when(F.col("d") <= F.col("mu") + radius, F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), (F.col("own") & inside).alias("o"))),
            F.when(F.col("d") > F.col("mu") - radius, F.struct(F.lit(1).alias("i"), F.lit(0).alias("j"), (F.col("own") & ~inside).alias("o"))),
        )
        mine = F.pmod(F.xxhash64("fp", "shard"), F.col("g")).cast("int")
        tiles = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j"), F.col("own").alias("o")))
        cut = at.select("shard", "fp", F.explode(F.when(F.col("gains"), F.filter(sides, lambda x: x.isNotNull())).otherwise(tiles)).alias("s"))
        cut = cut.select(F.xxhash64("shard", "s.i", "s.j").alias("shard"), "fp", F.col("s.o").alias("own"))
        shards = durable(small.unionByName(cut), "shards")
        for old in filter(None, (written, large, mid)):
            release(old)
        written = shards


def _whole_groups(batches: Iterator[pa.RecordBatch], least: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted rows in pieces that end where a shard ends."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = 0
    for b in batches:
        held.append((b.column("shard").to_numpy(), b.column("fp").to_numpy().view(np.uint64), b.column("own").to_numpy(zero_copy_only=False)))
        n += b.num_rows
        if n < least:
            continue
        keys, fp, own = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield keys[:cut], fp[:cut], own[:cut]
        held, n = [(keys[cut:], fp[cut:], own[cut:])], len(keys) - cut
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _link_sorted(keys: np.ndarray, fp: np.ndarray, own: np.ndarray, radius: int, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of each run of equal keys: runs of at most ``leaf`` are leaves themselves, compared all at once; larger ones get a tree."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    size_of = np.repeat(sizes, sizes)
    out_a, out_b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    lone = size_of <= leaf
    k, f, o = keys[lone], fp[lone], own[lone]
    for s in range(1, int(min(leaf, sizes.max(initial=0)))):
        same = k[s:] == k[:-s]
        if not same.any():
            break
        at = np.flatnonzero(same & (np.bitwise_count(f[s:] ^ f[:-s]) <= radius) & (o[s:] | o[:-s]))
        out_a.append(f[at])
        out_b.append(f[at + s])
    for at, n in zip(starts[sizes > leaf].tolist(), sizes[sizes > leaf].tolist(), strict=True):
        a, b = VantageTree(fp[at : at + n], leaf).forest(radius, own[at : at + n])
        out_a.append(fp[at + a])
        out_b.append(fp[at + b])
    return np.concatenate(out_a), np.concatenate(out_b)


class VantageTree:
    """A vantage-point tree over distinct 64-bit fingerprints. ``nodes``: (vantage point, mu, inside, outside), or the members of a leaf."""

    def __init__(self, fp: np.ndarray, leaf: int = 32):
        self.fp, self.nodes = fp, []
        self.root = self._grow(np.arange(len(fp)), leaf)

    def _grow(self, members: np.ndarray, leaf: int) -> int:
        at = len(self.nodes)
        self.nodes.append(members)
        if len(members) > leaf:
            vp = members[len(members) // 2]
            d = np.bitwise_count(self.fp[members] ^ self.fp[vp])
            mu = min(int(np.partition(d, len(d) // 2)[len(d) // 2]), int(d.max()) - 1)  # neither side is empty: the point itself is at 0
            inside = d <= mu
            if inside.any() and not inside.all():
                self.nodes[at] = (int(vp), mu, self._grow(members[inside], leaf), self._grow(members[~inside], leaf))
        return at

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(members of ``queries`` by index, indices of candidates): for each leaf that a query cannot skip; all within ``radius`` are among them."""
        todo = [(self.root, queries)]
        while todo:
            at, q = todo.pop()
            node = self.nodes[at]
            if not isinstance(node, tuple):
                yield q, node
                continue
            vp, mu, inside, outside = node
            d = np.bitwise_count(self.fp[q] ^ self.fp[vp]).astype(np.int64)
            for side, sub in ((outside, q[d > mu - radius]), (inside, q[d <= mu + radius])):
                if len(sub):
                    todo.append((side, sub))

    def forest(self, radius: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of indices that span the graph of pairs within ``radius``; a pair needs an owner at one end."""
        n = len(self.fp)
        own = np.ones(n, bool) if own is None else own
        label = np.arange(n)
        out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

        def link(a: np.ndarray, b: np.ndarray) -> None:
            nonlocal label
            la, lb = label[a], label[b]
            _, first = np.unique(np.minimum(la, lb) * n + np.maximum(la, lb), return_index=True)
            a, b, la, lb = a[first], b[first], la[first], lb[first]
            out_a.append(a)
            out_b.append(b)
            root = np.arange(n)
            while True:
                x, y = root[la], root[lb]
                if (x == y).all():
                    break
                np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                while (root[root] != root).any():
                    root = root[root]
            label = root[label]

        # what is near a vantage point hangs together through it: crowds fall into one label before any leaf is compared
        for node in self.nodes:
            if isinstance(node, tuple):
                vp = node[0]
                near = np.flatnonzero((np.bitwise_count(self.fp ^ self.fp[vp]) <= radius) & (label != label[vp]) & (own | own[vp]))
                if len(near):
                    link(near, np.full(len(near), vp))
        for q, members in self.search(np.arange(n), radius):
            for i in range(0, len(q), 1 << 16):
                part = q[i : i + (1 << 16)]
                hit = (np.bitwise_count(self.fp[part][:, None] ^ self.fp[members][None, :]) <= radius) & (label[part][:, None] != label[members][None, :]) & (own[part][:, None] | own[members][None, :])
                x, y = np.nonzero(hit)
                if len(x):
                    link(part[x], members[y])
        return np.concatenate(out_a), np.concatenate(out_b)


BANDS, ROWS = 25, 4
_DRAW = np.random.default_rng(336)
_TIMES = _DRAW.integers(0, 1 << 31, BANDS * ROWS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _DRAW.integers(0, 1 << 32, BANDS * ROWS).astype(np.uint32)


def shingle_set(text: bytes, width: int, cache: R.WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the ``width``-word shingles; fewer words are one shingle, none is none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = cache.of(words)
    if len(h) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    return np.unique(R.extend(h, 1, width))


def _majority(h: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * ones > len(h)).astype(np.uint64) << _BITS).sum(dtype=np.uint64))


def band_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``BANDS`` hashes per set: each joins the least values of ``ROWS`` hash functions. The empty set has zeros' hashes."""
    least = np.zeros((len(sets), BANDS * ROWS), np.uint32)
    for i, h in enumerate(sets):
        if len(h):
            x = (h >> np.uint64(32)).astype(np.uint32)
            least[i] = 0xFFFFFFFF
            for at in range(0, len(x), 4096):  # bounded memory for long texts
                np.minimum(least[i], (x[at : at + 4096, None] * _TIMES + _PLUS).min(axis=0), out=least[i])
    four = least.astype(np.uint64).reshape(len(sets), BANDS, ROWS)
    return R.mix(R.mix(four[:, :, 0], four[:, :, 1]), R.mix(four[:, :, 2], four[:, :, 3])) ^ R.mix(np.arange(BANDS, dtype=np.uint64), np.uint64(1))


#: Longs of a set's bitmap.
MAP = 16


def bitmap(h: np.ndarray) -> np.ndarray:
    """``MAP`` longs in which every hash sets one bit. A bit that only one of two sets has is a hash that the other lacks."""
    bits = np.zeros(64 * MAP, np.uint8)
    bits[(h >> np.uint64(20)) % np.uint64(64 * MAP)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def widest(similarity: float, lost: float = 1e-6) -> int:
    """Bits in which fingerprints of two sets of this Jaccard similarity differ, but for a share ``lost`` of the pairs: each bit
    differs with the probability of the angle between the sets, over pi."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    tail, k = 1.0, -1
    while tail > lost:
        k += 1
        tail -= math.comb(64, k) * p**k * (1 - p) ** (64 - k)
    return k


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``_k``: id and XXH64 of the text, which tells rows apart whatever their ids are."""
    return docs.withColumn("_k", F.struct(F.col(id_col).isNull().alias("null"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th")))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, width: int = 5, radius: int = 3, pivots: int = 1) -> DataFrame:
    """``(_k, v, component)``: the key of every row, its class of equal shingle sets, and the least class that can be reached over
    pairs whose ``width``-word shingle sets have an exact Jaccard similarity of ``similarity`` or more.

    Candidates come from fingerprints of the shingle sets. Those at most ``radius`` bits apart are found by vantage-point
    trees, all of them. At a similarity of 0.8 fingerprints are some ten bits apart, where no tree over 64 bits prunes; for what lies beyond the radius,
    fingerprints meet in the buckets of 25 min-hash bands of four rows, which a pair at 0.8 misses with a probability of 2e-6, and pairs
    further apart than ``widest`` are dropped, which loses another 1e-6. All candidates are verified on their whole sets.

    A crowded bucket is never spelled out. Shingles that occur in one candidate only bound what it can share: classes with too many of
    them drop out, pairs with too many are not formed. The rest of a bucket is first compared with ``pivots`` members in turn,
    beginning with the one that has the fewest shingles of its own; only pairs that are not connected by then are compared with
    each other, and of these a row is made only if the bitmaps of their sets leave room for the similarity: near copies of one text
    that are no near copies of each other differ in too many bits. A bucket whose members all hang together costs one row a member. None of this loses a pair.

    Only members of the same bucket with different components, and only the sets of classes that are in a candidate pair, are moved.
    Null and wordless texts are one class, the empty set. Repeated rows are one class. An empty table gives an empty result.
    """
    rows = _keyed(docs, id_col, text_col).select("_k", F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    kind = dict(rows.dtypes)["_k"]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = R.WordHashes()
        for b in batches:
            sets = [shingle_set(t.as_py(), width, cache) for t in b.column("t")]
            v = np.fromiter((xxhash.xxh3_64_intdigest(s.tobytes(), SEED) for s in sets), np.uint64, len(sets))
            fp = np.fromiter(map(_majority, sets), np.uint64, len(sets))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(band_hashes(sets).view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("_k"), pa.array(v.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(map(len, sets), pa.int64()), lists], ["_k", "v", "fp", "n", "bands"])

    sk = durable(rows.mapInArrow(sketch, f"_k {kind}, v bigint, fp bigint, n bigint, bands array<bigint>"), "sketch")
    reps = durable(sk.groupBy("v").agg(F.min("_k").alias("_k"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.first("bands").alias("bands")), "reps")
    same = durable(reps.groupBy("fp").agg(F.min("v").alias("f")), "same")
    links = link_fingerprints(same.select("fp"), radius)
    named = same.select(F.col("fp").alias("a"), F.col("f").alias("x")), same.select(F.col("fp").alias("b"), F.col("f").alias("y"))
    near = links.join(named[0], "a").join(named[1], "b").select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(reps.join(same, "fp").where("v <> f").select(F.col("f").alias("a"), F.col("v").alias("b")))
    near = durable(near, "near")
    banded = reps.select("v", "fp", "n", F.explode("bands").alias("band"))
    shared = durable(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "shared")
    members = durable(banded.join(shared, "band"), "members")
    # the whole sets of the classes that may be in a pair
    wanted = members.select("v").union(near.select(F.col("a").alias("v"))).union(near.select(F.col("b").alias("v"))).distinct()
    texts = rows.join(reps.select("_k", "v").join(wanted, "v"), "_k").select("v", "t")

    def collect_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = R.WordHashes()
        for b in batches:
            own = [shingle_set(t.as_py(), width, cache) for t in b.column("t")]
            maps = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([np.empty(0, np.int64), *map(bitmap, own)])), MAP).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("v"), pa.array([x.tobytes() for x in own], pa.binary()), maps], ["v", "s", "map"])

    sets = durable(texts.mapInArrow(collect_sets, "v bigint, s binary, map array<bigint>").dropDuplicates(["v"]), "sets")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for v, x in zip(b.column("v").to_pylist(), b.column("s").to_pylist(), strict=True):
                h = np.frombuffer(x, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), v))], ["h", "v"])

    # shingles that no other candidate has: a pair shares at most what each has besides these
    alone = sets.mapInArrow(spell, "h bigint, v bigint").groupBy("h").agg(F.count("*").alias("k"), F.min("v").alias("v")).where("k = 1").groupBy("v").agg(F.count("*").alias("u"))
    able = members.join(durable(alone, "alone"), "v", "left").withColumn("m", F.col("n") - F.coalesce("u", F.lit(0))).where(F.col("m") >= similarity * F.col("n"))
    members = durable(able.select("band", "v", "fp", "n", "m"), "able")

    def verified(pairs: DataFrame) -> tuple[DataFrame, int]:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.zeros(b.num_rows, bool)
                for i, (x, y) in enumerate(zip(b.column("sa"), b.column("sb"), strict=True)):
                    x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                    both = np.concatenate([x, y])
                    both.sort()
                    k = int((both[1:] == both[:-1]).sum())
                    keep[i] = k >= similarity * (len(both) - k)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep))

        whole = pairs.join(sets.select(F.col("v").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("v").alias("b"), F.col("s").alias("sb")), "b")
        return durable_counted(whole.mapInArrow(work, "a bigint, b bigint"), "verified")

    edges, _ = verified(near)
    label = durable(connected_components(edges), "label")
    apart = widest(similarity)
    for turn in range(pivots + 1):
        now = durable(members.join(label, F.col("v") == F.col("id"), "left").select("band", "v", "fp", "n", "m", F.coalesce("component", "v").alias("c")), "now")
        # first the member with the fewest shingles of its own, the one nearest to all others; then any
        first = F.struct((F.col("n") - F.col("m")) / F.greatest("n", F.lit(1)) if not turn else F.lit(0.0), F.xxhash64("v", F.lit(turn)))
        mixed = durable(now.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min_by(F.struct("v", "fp", "n", "m", "c"), first).alias("p")).where("lo <> hi").select("band", "p"), "mixed")
        if turn < pivots:
            met = now.join(mixed, "band").select("v", "fp", "n", "m", "c", *[F.col(f"p.{x}").alias(f"p{x}") for x in ("v", "fp", "n", "m", "c")])
        else:
            maps = sets.select("v", *[F.col("map")[i].alias(f"m{i}") for i in range(MAP)])
            maps = maps.withColumn("w", sum((F.bit_count(f"m{i}") for i in range(1, MAP)), F.bit_count("m0")))
            rest = durable(now.join(mixed.select("band"), "band").join(maps, "v"), "rest")
            met = rest.join(rest.select("band", *[F.col(x).alias(f"p{x}") for x in rest.columns if x != "band"]), "band").where("c < pc")
        shared_most = F.least("m", "pm")
        could = (F.col("c") != F.col("pc")) & (shared_most >= similarity * (F.col("n") + F.col("pn") - shared_most))
        could &= F.bit_count(F.col("fp").bitwiseXOR(F.col("pfp"))) <= apart
        if turn == pivots:
            # a set holds as many hashes of its own as it has bits that the other's map lacks, at least
            both = sum((F.bit_count(F.col(f"m{i}").bitwiseAND(F.col(f"pm{i}"))) for i in range(1, MAP)), F.bit_count(F.col("m0").bitwiseAND(F.col("pm0"))))
            could &= both + F.least(F.col("n") - F.col("w"), F.col("pn") - F.col("pw")) >= similarity / (1 + similarity) * (F.col("n") + F.col("pn")) - 1e-6
        close = met.where(could)
        pairs, n = durable_counted(close.select(F.least("v", "pv").alias("a"), F.greatest("v", "pv").alias("b")).distinct(), "pairs")
        more, n = verified(pairs) if n else (None, 0)
        if n:
            edges = edges.unionByName(more)
            label = durable(connected_components(edges), "label")
    return sk.select("_k", "v").join(label, F.col("v") == F.col("id"), "left").select("_k", "v", F.coalesce("component", "v").alias("component"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, width: int = 5) -> DataFrame:
    """The rows of ``docs``, unchanged, of which no other of their group (see ``similar_groups``) has a smaller id.

    Of rows of one id the one whose text has the least hash stays, of rows that repeat both one; a null id comes after all others.
    """
    groups = durable(similar_groups(docs, id_col, text_col, similarity, width), "groups")
    kept = groups.groupBy("component").agg(F.min("_k").alias("_k")).select("_k")
    times = groups.join(kept, "_k").groupBy("_k").agg(F.count("*").alias("_n"))
    once, repeated = durable(times, "kept"), F.col("_n") > 1
    out = _keyed(docs, id_col, text_col).join(once, "_k")
    if not once.where(repeated).limit(1).count():
        return out.drop("_k", "_n")
    first = out.where(repeated).withColumn("_i", F.row_number().over(Window.partitionBy("_k").orderBy("_n"))).where("_i = 1")
    return out.where(~repeated).unionByName(first.drop("_i")).drop("_k", "_n")
