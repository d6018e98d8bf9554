"""Related-document packing into fixed token windows.

Documents are tokenised once and written to the shared folder, each with a vector: hashed token counts on the first
principal axes of a sample, of length one. The nearest-neighbour graph over all different vectors comes from an inverted
file: centroids of the sample are cells, every vector lies in its nearest cell and is a query to its ``PROBES`` nearest
ones, and the best neighbours of all of them are merged. A cell too large for one task is dealt out in tiles that each
query visits. The index is fitted on a bounded sample (``SAMPLE``) but holds every document.

The vertices of the graph, without their documents, are then sorted by (cell, place in it), by ranges. A task takes them in blocks of bounded size,
in which greedy paths go from the vertex of lowest degree to its most similar unvisited neighbour, and end before a neighbour in another block that
is more similar than all that are left. Links between ends of different paths, from all blocks, join paths in the order of their similarity, until no such link
is left: a path ends only where no neighbour of its end is the open end of another path. Paths, one after another, give every document its place in one stream of tokens, which
is cut into windows. What is left at the end of the stream is cut into sequences whose lengths are powers of two, so nothing is padded.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.session import durable, release

WINDOW = 1024
DIMS = 256
#: Vertices of the graph that greedy paths run through at once.
BLOCK = 1 << 16
NEIGHBOURS = 8
#: Dimensions of the vectors; documents that the index is fitted on, about; vectors a cell, on average, and in one tile at most; cells that a query visits.
AXES, SAMPLE, PER_CELL, TILE, PROBES = 8, 8192, 512, 8192, 6
_NEAR = np.dtype([("v", "<i8"), ("s", "<f4")])
#: Tokens a task packs, about.
TASK_TOKENS = 4_000_000

@lru_cache(maxsize=2)
def encoder(name: str):
    """The byte-level BPE as ranks; the same ids as the vocabulary's JSON form gives, several times as fast.

    ``name`` is a ``.json`` or ``.tiktoken`` file of the public vocabularies, or a path to one. Added tokens of the JSON
    form, which lies beside the ranks, are recognised in texts as the contract's tokenizer does, so ``<|endoftext|>`` is one id.
    """
    import public_tokenizers as public

    path = name if "/" in name else public.path(name)
    if path.endswith(".tiktoken"):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
        form = path.removesuffix(".tiktoken") + ".json"
        added = {}
        if os.path.exists(form):
            with open(form) as f:
                added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        ranked = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        return lambda text: ranked.encode(text, allowed_special="all")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def vector(ids: np.ndarray) -> np.ndarray:
    """Damped counts of hashed ids, of length one."""
    c = np.bincount((ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24), minlength=DIMS).astype(np.float32)
    np.log1p(c, out=c)
    c -= c.mean()
    n = float(np.sqrt((c * c).sum()))
    return c / n if n else c


@dataclass(frozen=True)
class Index:
    """Projection of ``vector`` and the cells' centroids, in an order in which neighbours are alike."""

    mean: np.ndarray
    axes: np.ndarray
    centroids: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, rounds: int = 8) -> Index:
        """Principal axes and k-means of a sample of vectors (one a row)."""
        mean = x.mean(axis=0) if len(x) else np.zeros(DIMS, np.float32)
        _, _, vt = np.linalg.svd(x - mean, full_matrices=False) if len(x) else (0, 0, np.eye(AXES, DIMS, dtype=np.float32))
        axes = np.zeros((DIMS, AXES), np.float32)
        axes[:, : len(vt[:AXES])] = vt[:AXES].T
        own = cls(mean.astype(np.float32), axes, np.zeros((1, AXES), np.float32))
        y = np.unique(own.project(x), axis=0)
        if len(y) <= 1:
            return own
        c = y[np.random.default_rng(7).permutation(len(y))[:cells]]
        for _ in range(rounds):
            near = np.concatenate([np.argmax(y[i : i + 1024] @ c.T, axis=1) for i in range(0, len(y), 1024)])
            sums = np.zeros_like(c)
            np.add.at(sums, near, y)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(norm > 0, sums / np.maximum(norm, 1e-9), c).astype(np.float32)
        order, left = [int(np.argmin(c[:, 0]))], np.ones(len(c), bool)
        left[order[0]] = False
        while left.any():
            at = np.flatnonzero(left)
            order.append(int(at[np.argmax(c[at] @ c[order[-1]])]))
            left[order[-1]] = False
        return cls(own.mean, axes, c[order])

    def project(self, x: np.ndarray) -> np.ndarray:
        y = (x - self.mean) @ self.axes
        return (y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)).round(5).astype(np.float32)

    def probes(self, y: np.ndarray) -> np.ndarray:
        """The nearest cells of each vector, the nearest first."""
        sim = y @ self.centroids.T
        k = min(PROBES, sim.shape[1])
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        return np.take_along_axis(near, np.argsort(-np.take_along_axis(sim, near, 1), axis=1, kind="stable"), 1).astype(np.int32)


def fit_index(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, per_cell: int = PER_CELL) -> Index:
    """An index fitted on about ``sample`` documents (those of small id hashes, at most twice as many); a cell for every ``per_cell`` documents, but at least four sample documents a cell."""
    n = docs.count()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if n > sample:
        slim = slim.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < (sample << 30) // n).limit(2 * sample).repartition(docs.sparkSession.sparkContext.defaultParallelism)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([vector(np.array(encode(t.as_py()), np.uint16)).tobytes() for t in b.column("text")], pa.binary())], ["v"])

    rows = sorted(bytes(r["v"]) for r in slim.mapInArrow(work, "v binary").collect())  # 1 KB each, 2 * sample at most
    x = np.frombuffer(b"".join(rows), np.float32).reshape(-1, DIMS)
    return Index.fit(x, max(1, min(n // per_cell, len(x) // 4)))


def tokenise(docs: DataFrame, tokenizer: str, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n, vid, p, y, probes, ids)``: ids as little-endian unsigned 16-bit numbers, closed by id 0; null text is empty. ``y``: the vector, ``p``: its first axis, ``vid``: its hash."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            ids = [np.array(encode(t.as_py()), np.uint16) for t in b.column("text")]
            y = index.project(np.stack(list(map(vector, ids)))) if ids else np.empty((0, AXES), np.float32)
            probes = index.probes(y)
            at = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * probes.shape[1])
            cols = [b.column("doc_id"), pa.array([len(x) + 1 for x in ids], pa.int64()), pa.array(y[:, 0]), pa.array([x.tobytes() for x in y], pa.binary()), pa.ListArray.from_arrays(at, pa.array(probes.ravel())), pa.array([x.tobytes() + b"\0\0" for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "p", "y", "probes", "ids"])

    made = slim.mapInArrow(work, f"doc_id {dict(slim.dtypes)['doc_id']}, n bigint, p float, y binary, probes array<int>, ids binary")
    return made.select("doc_id", "n", F.xxhash64("y").alias("vid"), "p", "y", "probes", "ids")


def neighbours(tokens: DataFrame, k: int = NEIGHBOURS, tile: int = TILE) -> DataFrame:
    """``(vid, home, p, near)``: for every different vector its ``k`` most similar others, as ``_NEAR`` items, the most similar first."""
    verts = durable(tokens.select("vid", "y", "probes").dropDuplicates(["vid"]), "vertices")
    size = {r["c"]: r["n"] for r in verts.groupBy(F.col("probes")[0].alias("c")).agg(F.count("*").alias("n")).collect()}  # one row a cell
    tiles = {c: -(-n // tile) for c, n in size.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, key, role, home = [], [], [], []
            for i, (v, probes) in enumerate(zip(b.column("vid").to_pylist(), b.column("probes").to_pylist(), strict=True)):
                rows = [(c << 32 | t, 1) for c in probes for t in range(tiles.get(c, 0))] + [(probes[0] << 32 | v % tiles[probes[0]], 0)]
                at += [i] * len(rows)
                key += [r[0] for r in rows]
                role += [r[1] for r in rows]
                home += [probes[0]] * len(rows)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(role, pa.int32()), pa.array(home, pa.int32()), b.column("vid").take(at), b.column("y").take(at)], ["key", "role", "home", "vid", "y"])

    dealt = verts.mapInArrow(deal, "key bigint, role int, home int, vid bigint, y binary").repartition("key").sortWithinPartitions("key", "role", "vid")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ready = None, [], None
        for b in batches:
            keys, roles, vid = b.column("key").to_numpy(), b.column("role").to_numpy(), b.column("vid").to_numpy()
            home, y = b.column("home").to_numpy(), np.frombuffer(b"".join(b.column("y").to_pylist()), np.float32).reshape(-1, AXES)
            edge = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]) | (roles[1:] != roles[:-1])) + 1, len(keys)]
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if lo == hi:
                    continue
                if keys[lo] != key:
                    key, held, ready = keys[lo], [], None
                if not roles[lo]:
                    held.append((vid[lo:hi], y[lo:hi]))  # a tile: bounded
                    continue
                if ready is None:
                    ready = tuple(map(np.concatenate, zip(*held, strict=True))) if held else (np.empty(0, np.int64), np.empty((0, AXES), np.float32))
                for i in range(lo, hi, 512):
                    j = min(i + 512, hi)
                    sim = y[i:j] @ ready[1].T
                    sim[vid[i:j, None] == ready[0][None, :]] = -2
                    m = min(k, sim.shape[1])
                    best = np.argpartition(-sim, m - 1, axis=1)[:, :m] if m else np.empty((j - i, 0), np.int64)
                    out = np.empty(best.shape, _NEAR)
                    out["v"], out["s"] = ready[0][best], np.take_along_axis(sim, best, 1)
                    yield pa.RecordBatch.from_arrays([pa.array(vid[i:j]), pa.array(home[i:j]), pa.array(y[i:j, 0]), pa.array([x.tobytes() for x in out], pa.binary())], ["vid", "home", "p", "near"])

    found = dealt.mapInArrow(search, "vid bigint, home int, p float, near binary")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        parts: list[bytes] = []
        rows: list[tuple] = []

        def close() -> None:
            if last is not None:
                every = np.frombuffer(b"".join(parts), _NEAR)
                every = every[every["s"] > -2]
                rows.append((*last, every[np.lexsort((every["v"], -every["s"]))[:k]].tobytes()))
                parts.clear()

        def batch() -> pa.RecordBatch:
            v, h, p, near = zip(*rows, strict=True)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(h, pa.int32()), pa.array(p, pa.float32()), pa.array(near, pa.binary())], ["vid", "home", "p", "near"])

        for b in batches:
            for v, h, p, near in zip(*[b.column(c).to_pylist() for c in ("vid", "home", "p", "near")], strict=True):
                if last is None or v != last[0]:
                    close()
                    last = v, h, p
                parts.append(near)
            if rows:
                yield batch()
        close()
        if rows:
            yield batch()

    return found.repartition("vid").sortWithinPartitions("vid").mapInArrow(merge, "vid bigint, home int, p float, near binary")


def walk_paths(n: int, a: np.ndarray, b: np.ndarray, sim: np.ndarray, beyond: np.ndarray | None = None) -> list[list[int]]:
    """All of 0 .. n - 1 in greedy paths over undirected edges: each starts at the unvisited vertex of lowest degree and goes to the most similar unvisited neighbour.

    ``beyond``: the similarity of each vertex's best neighbour elsewhere; a path ends where that is higher than what is left here.
    """
    a, b, sim = np.r_[a, b], np.r_[b, a], np.r_[sim, sim]
    _, once = np.unique(a * n + b, return_index=True)
    a, b, sim = a[once], b[once], sim[once]
    degree = np.bincount(a, minlength=n)
    order = np.lexsort((b, degree[b], -sim, a))
    a, b, sim = a[order], b[order], sim[order].tolist()
    first = np.searchsorted(a, np.arange(n + 1)).tolist()
    b = b.tolist()
    least = (np.full(n, -np.inf) if beyond is None else beyond).tolist()
    seen = [False] * n
    out: list[list[int]] = []
    for start in np.lexsort((np.arange(n), degree)).tolist():
        v, path = start, []
        while v >= 0 and not seen[v]:
            seen[v] = True
            path.append(v)
            i = next((i for i in range(first[v], first[v + 1]) if not seen[b[i]]), -1)
            v = b[i] if i >= 0 and sim[i] >= least[v] else -1
        if path:
            out.append(path)
    return out


def walk(n: int, a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> list[int]:
    """``walk_paths``, one path after another."""
    return [v for path in walk_paths(n, a, b, sim) for v in path]


def _walks(block: int):
    """``(vid, frag, at, side, near)``: each vertex's path and place in it. ``side`` is 1 for the first of a path, 2 for the last, 3 for both; only these keep their list."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        frag = TaskContext.get().partitionId() << 32
        vids: list[int] = []
        near: list[bytes] = []

        def close() -> pa.RecordBatch:
            nonlocal frag
            n, of = len(vids), np.repeat(np.arange(len(vids)), [len(x) // _NEAR.itemsize for x in near])
            every, own = np.frombuffer(b"".join(near), _NEAR), np.array(vids, np.int64)
            order = np.argsort(own)
            to = order[np.searchsorted(own, every["v"], sorter=order).clip(max=n - 1)] if n else np.empty(0, np.int64)
            here = own[to] == every["v"]
            beyond = np.full(n, -np.inf, np.float32)
            np.maximum.at(beyond, of[~here], every["s"][~here])
            rows = []
            for path in walk_paths(n, of[here], to[here], every["s"][here], beyond):
                for i, v in enumerate(path):
                    side = (i == 0) + 2 * (i == len(path) - 1)
                    rows.append((vids[v], frag, i, side, near[v] if side else None))
                frag += 1
            vids.clear()
            near.clear()
            c = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in c[:4]], pa.array(c[4], pa.binary())], ["vid", "frag", "at", "side", "near"])

        for b in batches:
            for v, x in zip(b.column("vid").to_pylist(), b.column("near").to_pylist(), strict=True):
                vids.append(v)
                near.append(x)
                if len(vids) >= block:
                    yield close()
        if vids:
            yield close()

    return work


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("near").to_pylist()
        at, every = pa.array(np.repeat(np.arange(len(lists)), [len(x) // _NEAR.itemsize for x in lists])), np.frombuffer(b"".join(lists), _NEAR)
        yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in ("vid", "frag", "side")], pa.array(every["v"].copy()), pa.array(every["s"].copy())], ["a", "fa", "sa", "b", "s"])


def _joins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(frag, path, rank, flip)`` of the paths that links join. A link is taken if both its ends are open and lie on different paths; links come in their order."""
    root: dict[int, int] = {}
    full: dict[int, int] = {}
    near: dict[int, list[tuple[int, int, int]]] = {}

    def top(f: int) -> int:
        while (up := root.get(f, f)) != f:
            root[f] = root.get(up, up)
            f = up
        return f

    for b in batches:
        for a, fa, sa, c, fc, sc in zip(*[b.column(x).to_pylist() for x in ("a", "fa", "sa", "b", "fb", "sb")], strict=True):
            if full.get(a, 0) > (sa == 3) or full.get(c, 0) > (sc == 3) or (x := top(fa)) == (y := top(fc)):
                continue
            root[x] = y
            full[a], full[c] = full.get(a, 0) + 1, full.get(c, 0) + 1
            near.setdefault(fa, []).append((fc, sa, sc))
            near.setdefault(fc, []).append((fa, sc, sa))
    out, done = [], set()
    for head in sorted(f for f, x in near.items() if len(x) == 1):
        if head in done:
            continue
        f, came, flip, rank = head, None, near[head][0][1] == 1, 0
        while True:
            done.add(f)
            out.append((f, head, rank, flip))
            onward = [x for x in near[f] if x[0] != came]
            if not onward:
                break
            came, f, flip, rank = f, onward[0][0], onward[0][2] == 2, rank + 1
    for i in range(0, len(out), 1 << 16):
        f, h, r, x = zip(*out[i : i + (1 << 16)], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(h, pa.int64()), pa.array(r, pa.int64()), pa.array(x, pa.bool_())], ["frag", "path", "rank", "flip"])


def paths(graph: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(vid, path, rank, at)``: the order of all vertices, path by path. ``graph``: as ``neighbours`` gives it.

    Blocks only decide where greedy paths begin and end at first. Every link between open ends is then seen by one task, in the order of
    similarity, which holds some hundred bytes a path with such a link, not the links.
    """
    parts = max(1, -(-graph.count() // (4 * block)))
    order = ["home", "p", "vid"]
    walked = durable(graph.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_walks(block), "vid bigint, frag bigint, at bigint, side bigint, near binary"), "walked")
    ends = walked.where("side > 0")
    links = ends.mapInArrow(_spelled, "a bigint, fa bigint, sa bigint, b bigint, s float").join(ends.select(F.col("vid").alias("b"), F.col("frag").alias("fb"), F.col("side").alias("sb")), "b").where("fa <> fb")
    swap = F.col("a") > F.col("b")
    links = links.select("s", *[F.when(swap, y).otherwise(F.col(x)).alias(x) for x, y in [(i, F.col(j)) for i, j in (("a", "b"), ("fa", "fb"), ("sa", "sb"), ("b", "a"), ("fb", "fa"), ("sb", "sa"))]])
    links = links.repartition(1).sortWithinPartitions(F.desc("s"), "a", "b")
    joined = durable(links.mapInArrow(_joins, "frag bigint, path bigint, rank bigint, flip boolean"), "joined")
    at = F.when(F.col("flip"), -F.col("at")).otherwise(F.col("at"))
    out = durable(walked.select("vid", "frag", "at").join(joined, "frag", "left").select("vid", F.coalesce("path", "frag").alias("path"), F.coalesce("rank", F.lit(0)).alias("rank"), at.alias("at")), "paths")
    release(walked)
    release(joined)
    return out


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(row, n, part, start)``: where each row's tokens start among those of its task."""
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.column("n").to_numpy()
        ends = at + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("n"), pa.array(np.full(len(n), part)), pa.array(ends - n)], ["row", "n", "part", "start"])
        at = int(ends[-1]) if len(ends) else at


def _pieces(window: int, total: int, with_ids: bool):
    cuts, at = [], total // window * window
    while at < total:  # powers of two, the largest first
        cuts.append(at)
        at += 1 << ((total - at).bit_length() - 1)
    cuts = np.array([*cuts, total], np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc, x, pos in zip(b.column("doc_id").to_pylist(), b.column("ids"), b.column("pos").to_pylist(), strict=True):
                ids = np.frombuffer(x.as_py(), np.uint16)
                at = 0
                while at < len(ids):
                    here = pos + at
                    if here < cuts[0]:
                        sequence, first = divmod(here, window)
                        first, end = sequence * window, sequence * window + window
                    else:
                        k = int(np.searchsorted(cuts, here, "right")) - 1
                        sequence, first, end = int(cuts[0]) // window + k, int(cuts[k]), int(cuts[k + 1])
                    own = ids[at : at + end - here]
                    rows.append((doc, at, len(own), zlib.crc32(own.astype("<u4").tobytes()), len(ids), sequence, here - first, own.tobytes() if with_ids else None))
                    at += len(own)
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field("doc_id").type), *[pa.array(c, pa.int64()) for c in cols[1:7]], pa.array(cols[7], pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return work


def pack_related(docs: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken", window: int = WINDOW, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids)``: one row per piece of a document in a sequence.

    Every document's ids, closed by id 0, lie in exactly one place each. Sequences hold ``window`` (a power of two)
    tokens, but for at most ``log2(window)`` whose lengths are smaller powers of two: none is padded.
    ``ids`` (with ``with_ids``) are the piece's ids as unsigned 16-bit numbers.

    Null and empty texts are the single id 0. Repeated rows are packed each. Long documents run through as many
    sequences as they need. Null ids are kept. An empty table gives an empty result; extra columns are ignored.
    """
    index = fit_index(docs, tokenizer, id_col, text_col)
    made = durable(tokenise(docs, tokenizer, index, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "tokens")
    total = made.agg(F.sum("n").alias("n")).first()["n"] or 0
    graph = durable(neighbours(made), "graph")
    placed = paths(graph)
    release(graph)
    parts = max(1, -(-total // TASK_TOKENS))
    kind = dict(made.dtypes)["doc_id"]
    order = ["path", "rank", "at", "vid", "doc_id", "row"]
    stream = made.select("row", "doc_id", "vid", "n").join(placed, "vid").repartitionByRange(-(-parts // 8), *order).sortWithinPartitions(*order).select("row", "n")
    stream = durable(stream.mapInArrow(_starts, "row bigint, n bigint, part bigint, start bigint"), "stream")
    release(placed)
    base, before = [], 0
    for r in stream.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # one row a task
        base.append((r["part"], before))
        before += r["n"]
    offsets = made.sparkSession.createDataFrame(base, "part bigint, base bigint")
    at = stream.join(F.broadcast(offsets), "part").select("row", (F.col("start") + F.col("base")).alias("pos"))
    dealt = made.select("row", "doc_id", "ids").repartition(parts, "row").join(at.repartition(parts, "row").hint("shuffle_hash"), "row").select("doc_id", "ids", "pos")
    return dealt.mapInArrow(_pieces(window, total, with_ids), f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
