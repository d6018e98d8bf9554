"""Exact line dedup, exact document dedup and MinHash near-duplicate dedup."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions.words import held, lines
from siftlake.operators.components import connected_components
from siftlake.session import durable, durable_counted


def line_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(line, count)`` over all texts; empty texts have no line."""
    return docs.where((F.col(text).isNotNull()) & (F.col(text) != "")).select(F.explode(lines(F.col(text))).alias("line")).groupBy("line").agg(F.count("*").alias("count"))


def exact_line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text)``: every line that occurs more than once in the corpus is gone everywhere; each document stays.

    Survivors keep their order, and the closing line feed if the document had one. Lines travel as hashes: the count and
    the semi-join shuffle 16-byte keys, and the texts are read once more only to be rebuilt. Two different lines would
    have to agree in 128 hash bits to be taken for each other. Null texts stay null; keys must be unique.
    """
    real = docs.where((F.col(text).isNotNull()) & (F.col(text) != ""))
    hashed = lambda c: F.struct(F.xxhash64(c), F.xxhash64(c, F.lit(7)))
    own = real.select(F.col(key).alias("_k"), F.posexplode(F.transform(lines(F.col(text)), hashed)).alias("_i", "_h"))
    repeated = own.groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1").select("_h")
    # what is dropped is smaller than what stays in a clean corpus, and the hot lines are few keys
    gone = own.join(repeated, "_h", "left_semi").groupBy("_k").agg(F.collect_list("_i").alias("_gone"))
    both = docs.join(gone, F.col(key) == F.col("_k"), "left")
    hit = F.col("_gone").isNotNull()
    split = held(both, "_ls", F.when(hit, lines(F.col(text))))
    left = F.array_except(F.sequence(F.lit(0), F.size("_ls") - 1), "_gone")  # hashed, in order
    cut = held(split, "_kept", F.when(hit, F.transform(left, lambda i: F.get(F.col("_ls"), i))))
    rebuilt = F.when(F.size("_kept") == 0, "").otherwise(F.concat(F.array_join("_kept", "\n"), F.when(F.col(text).endswith("\n"), "\n").otherwise("")))
    return cut.select(key, F.when(hit, rebuilt).otherwise(F.col(text)).alias(text))


def exact_document_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of the rows of one text, the one of the smallest key. Null texts are kept. Only hashes and keys are shuffled for the choice."""
    firsts = docs.where(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("_h")).agg(F.min(key).alias(key)).select(key)
    return docs.join(firsts, key, "left_semi").unionByName(docs.where(F.col(text).isNull()))


@dataclass(frozen=True)
class MinHash:
    """num_hashes must be a multiple of num_bands."""

    num_hashes: int = 100
    num_bands: int = 25
    ngrams: int = 5
    jaccard_threshold: float = 0.8

    def __post_init__(self) -> None:
        if self.num_hashes % self.num_bands:
            raise ValueError("num_hashes must be a multiple of num_bands")


_SPLIT = re.compile(rb"[ \t\n\r]+")
_ODD = re.compile(rb"[\x0b\x0c\x1c-\x1f]")
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _WordHashes(dict):
    """XXH3 of words, remembered; bounded by starting anew."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v


def shingle_set(lower: bytes, n: int, cache: _WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the word n-grams of a lower-cased text; fewer words are one n-gram, none is none."""
    words = [w for w in _SPLIT.split(lower) if w] if _ODD.search(lower) else lower.split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    out = np.full(max(len(h) - n + 1, 1), len(h) if len(h) < n else n, np.uint64)
    for i in range(min(n, len(h))):
        out = (out ^ h[i : i + len(out)]) * _C1
        out = (out ^ (out >> np.uint64(29))) * _C2
        out ^= out >> np.uint64(32)
    return np.unique(out)


def sketches(docs: DataFrame, p: MinHash, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(_k, c, n, bands)`` of the texts with words: a digest and the size of the set of word n-grams, and one hash a band of its signature.

    A signature has, for each seed, the least seeded hash of the set, 32 bits wide. Lower-casing is Spark's; sets, digests and signatures are made in
    Arrow batches, where a lambda function would be interpreted once per n-gram and seed.
    """
    draw = np.random.default_rng(336)
    times = draw.integers(0, 1 << 31, p.num_hashes).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    plus = draw.integers(0, 1 << 32, p.num_hashes).astype(np.uint32)
    rows = p.num_hashes // p.num_bands
    slim = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.lower(text).cast("binary").alias("t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHashes()
        for b in _slices(batches):
            sets = [shingle_set(t.as_py(), p.ngrams, cache) for t in b.column("t")]
            kept = np.flatnonzero([len(s) > 0 for s in sets])
            bands = np.zeros((len(kept), p.num_bands), np.uint64)
            for i, j in enumerate(kept.tolist()):
                x = (sets[j] >> np.uint64(32)).astype(np.uint32)
                least = np.full(p.num_hashes, 0xFFFFFFFF, np.uint32)
                for at in range(0, len(x), 4096):  # bounded memory for long texts
                    np.minimum(least, (x[at : at + 4096, None] * times + plus).min(axis=0), out=least)
                h = np.arange(p.num_bands, dtype=np.uint64)
                for part in least.reshape(p.num_bands, rows).T:
                    h = (h ^ part) * _C1
                    h = (h ^ (h >> np.uint64(31))) * _C2
                bands[i] = h
            ends = pa.array(np.arange(len(kept) + 1, dtype=np.int32) * p.num_bands)
            lists = pa.ListArray.from_arrays(ends, pa.array(bands.view(np.int64).ravel()))
            digest = pa.array([xxhash.xxh3_128_digest(sets[j].tobytes()) for j in kept], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("_k").take(pa.array(kept)), digest, pa.array([len(sets[j]) for j in kept], pa.int64()), lists], ["_k", "c", "n", "bands"])

    return slim.mapInArrow(work, f"_k {dict(slim.dtypes)['_k']}, c binary, n bigint, bands array<bigint>")


def band_keys(sk: DataFrame) -> DataFrame:
    """``(_k, band)``: one row a band."""
    return sk.select("_k", F.explode("bands").alias("band"))


#: Bits of a set's map, and bytes of texts that are turned into sets at a time.
_MAP, _SLICE = 2048, 4 << 20


@dataclass
class _Banded:
    """Classes of equal sets in buckets: ``member`` (_k, c), ``rep`` (c, _r), ``bands`` (_k, band) of buckets with two classes or more, ``sets`` (_k, n, m, s) of their classes: size, map of bits, hashes."""

    member: DataFrame
    rep: DataFrame
    bands: DataFrame
    sets: DataFrame


def _slices(batches: Iterator[pa.RecordBatch], column: str = "t") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of some ``_SLICE`` bytes of ``column``: what is made of them stays small, whatever the session's batches hold."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _SLICE, "right")), at + 1)
            yield b.slice(at, to - at)
            at = to


def _map(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(_MAP, np.uint8)
    bits[(hashes >> np.uint64(20)) % np.uint64(_MAP)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *parts])))


def _among(keys: DataFrame, n: int, most: int = 1 << 27) -> Callable[[np.ndarray], np.ndarray]:
    """A test of XXH64 hashes of keys that holds for every key of ``keys`` (one column, ``n`` rows), and for few others.

    The keys' hashes are bits, 64 a key or more and ``most`` (16 MB) in all, which every worker gets; beyond some millions of keys
    more of the others pass. It spares rows a shuffle; what passes has still to be held against the keys.
    """
    size = min(max(1 << (64 * max(n, 1) - 1).bit_length(), 1 << 10), most)
    h = F.xxhash64(keys.columns[0]).bitwiseAND(size - 1)
    found = keys.select(h.alias("h")).groupBy(F.shiftright("h", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("w")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[found["i"].to_numpy()] = found["w"].to_numpy().view(np.uint64)
    sent = keys.sparkSession.sparkContext.broadcast(bits)

    def test(hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(np.uint64) & np.uint64(size - 1)
        return (sent.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1

    return test


def _banded(docs: DataFrame, p: MinHash, key: str, text: str) -> _Banded:
    """One pass over the texts for the sketches, and another over those whose class shares a bucket for their whole sets. No text is shuffled."""
    sk = durable(sketches(docs, p, key, text), "sketches")
    member = sk.select("_k", "c")
    reps = durable(sk.groupBy("c").agg(F.min("_k").alias("_k"), F.first("bands").alias("bands")), "reps")
    banded = band_keys(reps)
    shared = durable(banded.groupBy("band").agg(F.count("*").alias("_n")).where("_n > 1").select("band"), "shared")
    bands = durable(banded.join(shared, "band"), "bands")
    wanted, n = durable_counted(bands.select("_k").distinct(), "wanted")
    among = _among(wanted, n)
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.xxhash64(key).alias("h"), F.lower(text).cast("binary").alias("t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHashes()
        for b in _slices(b.filter(pa.array(among(b.column("h").to_numpy()))) for b in batches):  # a few sets too many, which no pair asks for
            own = [shingle_set(t.as_py(), p.ngrams, cache) for t in b.column("t")]
            yield pa.RecordBatch.from_arrays([b.column("_k"), pa.array([len(s) for s in own], pa.int64()), _lists([_map(s) for s in own]), _lists([s.view(np.int64) for s in own])], ["_k", "n", "m", "s"])

    sets = durable(texts.mapInArrow(work, f"_k {dict(docs.dtypes)[key]}, n bigint, m array<bigint>, s array<bigint>"), "sets")
    return _Banded(member, reps.select("c", F.col("_k").alias("_r")), bands, sets)


def near_duplicate_pairs(docs: DataFrame, p: MinHash = MinHash(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(a, b, jaccard)`` with a < b between representatives of equal shingle sets, exactly verified, at or above the threshold.

    Documents of one shingle set are one class: its smallest key stands for it in the join, so a large group of copies adds
    one row. ``near_duplicate_clusters`` adds the members. Keys must be unique.
    """
    own = _banded(docs, p, key, text)
    x, y = own.bands.select(F.col("_k").alias("a"), "band"), own.bands.select(F.col("_k").alias("b"), "band")
    return _verified(x.join(y, "band").where("a < b").select("a", "b").distinct(), own.sets, p)


def _links(own: _Banded, p: MinHash) -> DataFrame:
    """Verified pairs that connect what ``near_duplicate_pairs`` connects, without spelling out crowded buckets.

    A bucket is first compared with its smallest member only. Members near it are connected already, so of the other
    pairs just those with a member that is not near it are left to compare.
    """
    heads = durable(own.bands.groupBy("band").agg(F.min("_k").alias("a")), "heads")
    star = durable(own.bands.join(heads, "band").where("_k <> a").select("band", "a", F.col("_k").alias("b")), "star")
    near = durable(_verified(star.select("a", "b").distinct(), own.sets, p), "near")
    rest = star.join(near, ["a", "b"], "left_anti").select("band", F.col("b").alias("x"))
    pairs, n = durable_counted(rest.join(own.bands, "band").where("x <> _k").select(F.least("x", "_k").alias("a"), F.greatest("x", "_k").alias("b")).distinct(), "pairs")
    # written, as the components read their edges more than once
    return near.unionByName(durable(_verified(pairs, own.sets, p), "far")) if n else near


def _verified(pairs: DataFrame, sets: DataFrame, p: MinHash) -> DataFrame:
    """Pairs with their exact Jaccard value, at or above the threshold.

    A pair meets the whole sets only if sizes and maps leave room for the threshold: a set has as many hashes of its own as
    its map has bits that the other's lacks, at least.
    """
    both = pairs
    for x in "ab":
        both = both.join(sets.select(F.col("_k").alias(x), F.col("n").alias(f"n{x}"), F.col("m").alias(f"m{x}")), x)
    lacks = lambda m, o: F.aggregate(F.zip_with(m, o, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda s, x: s + x)
    shared = F.least(F.col("na") - lacks("ma", "mb"), F.col("nb") - lacks("mb", "ma"))
    left = both.where(F.least("na", "nb") >= p.jaccard_threshold * F.greatest("na", "nb") - 1e-6).where(shared >= p.jaccard_threshold * (F.col("na") + F.col("nb") - shared) - 1e-6)
    whole = left.select("a", "b", "na", "nb")
    for x in "ab":
        whole = whole.join(sets.select(F.col("_k").alias(x), F.col("s").alias(f"s{x}")), x)
    k = F.size(F.array_intersect("sa", "sb"))
    return held(whole, "k", k).select("a", "b", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("jaccard")).where(F.col("jaccard") >= p.jaccard_threshold)


def near_duplicate_clusters(docs: DataFrame, p: MinHash = MinHash(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, cluster)`` for every document; ``cluster`` is the smallest key that can be reached over verified pairs and copies."""
    own = _banded(docs, p, key, text)
    comp = connected_components(_links(own, p))
    of = own.member.join(own.rep, "c").join(comp, F.col("_r") == F.col("id"), "left").select("_k", F.coalesce("component", "_r").alias("cluster"))
    bare = docs.select(key).join(of, F.col(key) == F.col("_k"), "left")
    return bare.select(key, F.coalesce("cluster", key).alias("cluster"))


def minhash_dedup(docs: DataFrame, p: MinHash = MinHash(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, unchanged, of which no other of their cluster has a smaller key. Only those that may go are shuffled."""
    others, n = durable_counted(near_duplicate_clusters(docs, p, key, text).where(F.col("cluster") != F.col(key)).select(key), "others")
    among = _among(others, n)
    may_go = F.arrow_udf(lambda h: pa.array(among(h.to_numpy())), "boolean")(F.xxhash64(key))
    return docs.where(~may_go).unionByName(docs.where(may_go).join(others, key, "left_anti"))
