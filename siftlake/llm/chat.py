"""Chat formatting of reply trees.

Messages form trees by parent links. Iterative self-joins double, round by round, how far up each message sees: after k
rounds it knows the message 2^k above it and the scores between. The last round gives every leaf the score of its path,
by which a tree's paths are ranked; a second series of joins over the same tables spells out the chosen paths, doubling
what is known of each. A path of n messages takes about 2 log2(n) rounds, however the tree branches. Every chosen path
becomes one formatted conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from siftlake.session import Log, durable, release

#: A turn is ``### <role>: <text> </turn>\n``. A backslash, and a backslash before every control string, make texts safe.
OPEN, COLON, CLOSE = "### ", ": ", " </turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>|:|\n")
_TEXT_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str, role: bool = False) -> str:
    return (_CONTROL if role else _TEXT_CONTROL).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[int], list[int]]:
    """The formatted conversation and the starts and ends of its loss mask: exactly the escaped texts of ``learn``."""
    out, at, starts, ends = [], 0, [], []
    for role, text in turns:
        head, body = OPEN + escape(role, True) + COLON, escape(text)
        if role == learn:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), starts, ends


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; a text that is not one is an error."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        colon = _next(formatted, at + len(OPEN), COLON)
        close = _next(formatted, colon + len(COLON), CLOSE)
        turns.append((unescape(formatted[at + len(OPEN) : colon]), unescape(formatted[colon + len(COLON) : close])))
        at = close + len(CLOSE)
    return turns


def _next(s: str, at: int, mark: str) -> int:
    """The first ``mark`` from ``at`` on that no backslash escapes. Linear: a mark after an escape is looked at once."""
    while True:
        found = s.find(mark, at)
        if found < 0:
            raise ValueError("the conversation is cut off")
        # the mark's own first or second character may be escaped: count the backslashes just before it
        for k in (0, 1):
            i = found + k
            n = i
            while n > at and s[n - 1] == "\\":
                n -= 1
            if (i - n) % 2:
                break
        else:
            return found
        at = found + 1


def reply_paths(messages: DataFrame, tree: str = "conv_id", message: str = "msg", parent: str = "parent", score: str = "score", top: int | None = None) -> DataFrame:
    """Root-to-leaf paths: ``(tree, leaf, path_score, path_rank, turns)``, ``turns`` an array of the messages' structs in order.

    ``messages`` has one row per message: the tree's id, a message id, the parent's message id (null at a root), a score
    (null: 0) and anything else, which is kept in the structs (columns must be orderable). A path's score is the sum of
    its messages' scores, ranked from the highest (ties: smaller leaf id); ``top`` keeps that many paths a tree (None:
    all). A parent that does not exist, or that is the message itself, makes its message a root. Of repeated rows of one
    (tree, message) the least one counts. A cycle has no root: it and what hangs on it give no path. A null tree id is a tree
    like any other; a null message id is a message that nothing can answer. An empty table gives an empty result.

    Rounds: twice the binary logarithm of the longest path, branching or not; a round's plan does not grow with their number.
    """
    cols = list(messages.columns)
    # structs as keys: null ids then equal themselves in joins
    row = F.struct(F.col(parent).alias("p"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("s"), F.struct(*cols).alias("msg"))
    keyed = messages.select(F.struct(F.col(tree).alias("id")).alias("_t"), F.struct(F.col(message).alias("id")).alias("_m"), row.alias("_r"))
    m = durable(keyed.groupBy("_t", "_m").agg(F.min("_r").alias("_r")), "messages")
    slim = m.select("_t", "_m", F.when(F.col("_r.p").isNotNull() & ~F.col("_r.p").eqNullSafe(F.col("_m.id")), F.struct(F.col("_r.p").alias("id"))).alias("_p"), F.col("_r.s").alias("_s"))
    known = slim.select("_t", F.col("_m").alias("_p"), F.lit(True).alias("_there"))
    # _up: the message 2^k above (null: the path begins before), _s: the scores from here up to, without, that message
    step = durable(slim.join(known, ["_t", "_p"], "left").select("_t", "_m", F.expr("if(_there, _p, null)").alias("_up"), "_s"), "hop")
    hops, settled = [step], Log(step.where("_up is null").select("_t", "_m", "_s"), "settled")
    leaves = step.select("_t", "_m").join(step.where("_up is not null").select("_t", F.col("_up").alias("_m")).distinct(), ["_t", "_m"], "left_anti")
    for _ in range(step.count().bit_length() + 1):  # what is open after that is on a cycle or hangs on one
        open_ = hops[-1].where("_up is not null")  # only messages that do not see their root yet take part
        above = open_.select("_t", F.col("_m").alias("_up"), F.col("_up").alias("_far"), F.col("_s").alias("_more")).unionByName(settled.read().select("_t", F.col("_m").alias("_up"), F.lit(None).cast(step.schema["_up"].dataType).alias("_far"), F.col("_s").alias("_more")))
        seen = Observation()
        nearer = open_.join(above, ["_t", "_up"]).select("_t", "_m", F.col("_far").alias("_up"), (F.col("_s") + F.col("_more")).alias("_s"))
        hops.append(durable(nearer.observe(seen, F.count("_up").alias("open")), "hop"))
        settled.append(hops[-1].where("_up is null").select("_t", "_m", "_s"))
        if not seen.get["open"]:
            break
    ends = leaves.join(settled.read(), ["_t", "_m"])
    ranked = ends.withColumn("_rank", F.row_number().over(Window.partitionBy("_t").orderBy(F.desc("_s"), "_m")))
    if top is not None:
        ranked = ranked.where(F.col("_rank") <= top)
    ranked = durable(ranked.select("_t", F.col("_m").alias("_leaf"), F.col("_s").alias("_score"), "_rank"), "ranked")
    # each round adds the ancestors at 2^k .. 2^(k+1) - 1 of the leaves
    path = Log(ranked.select("_t", "_leaf", F.col("_leaf").alias("_m"), F.lit(0).cast("long").alias("_i")), "path")
    for k, hop in enumerate(hops):
        up = hop.where("_up is not null").select("_t", "_m", "_up")
        more = path.read().join(up, ["_t", "_m"]).select("_t", "_leaf", F.col("_up").alias("_m"), (F.col("_i") + (1 << k)).alias("_i"))
        if not path.append(more):
            break
    for hop in hops:
        release(hop)
    full = path.read().join(m.select("_t", "_m", "_r.msg"), ["_t", "_m"])
    told = full.groupBy("_t", "_leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("_i")).alias("i"), "msg"))).alias("_all"))
    out = told.join(ranked, ["_t", "_leaf"])
    return out.select(F.col("_t.id").alias(tree), F.col("_leaf.id").alias("leaf"), F.col("_score").alias("path_score"), F.col("_rank").alias("path_rank"), F.col("_all.msg").alias("turns"))


def format_paths(paths: DataFrame, tree: str = "conv_id", role: str = "role", text: str = "text") -> DataFrame:
    """``(tree, leaf, formatted, mask_starts, mask_ends)``: one formatted conversation a path, mask in code points.

    Null roles and texts are empty strings, which give an empty turn (and, for the assistant, an empty stretch of the mask).
    Repeated paths are formatted each; an empty table gives an empty result; other columns are left out. A conversation is one
    value: it has to fit in a row.
    """
    slim = paths.select(tree, "leaf", F.transform("turns", lambda x: F.coalesce(x[role], F.lit(""))).alias("r"), F.transform("turns", lambda x: F.coalesce(x[text], F.lit(""))).alias("x"))
    kind = dict(slim.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [format_turns(list(zip(r, x, strict=True))) for r, x in zip(b.column("r").to_pylist(), b.column("x").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(tree), b.column("leaf"), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.list_(pa.int64())), pa.array([m[2] for m in made], pa.list_(pa.int64()))], ["tree", "leaf", "formatted", "mask_starts", "mask_ends"])

    return slim.mapInArrow(work, f"tree {kind[tree]}, leaf {kind['leaf']}, formatted string, mask_starts array<bigint>, mask_ends array<bigint>").withColumnRenamed("tree", tree)


def chained(rows: DataFrame, tree: str = "conv_id", order: str = "turn") -> DataFrame:
    """Turn-ordered rows as reply trees without branches: message n answers n - 1. Ties go by role, then text; repeated rows stay."""
    w = Window.partitionBy(tree).orderBy(F.col(order).asc_nulls_first(), "role", "text")
    numbered = rows.select(tree, "role", "text", order).withColumn("msg", F.row_number().over(w).cast("long"))
    return numbered.withColumn("parent", F.when(F.col("msg") > 1, F.col("msg") - 1)).withColumn("score", F.length(F.coalesce("text", F.lit(""))).cast("double"))


def digests(formatted: DataFrame, tree: str = "conv_id") -> DataFrame:
    """What reading the output back gives: turns and everything under the loss mask, one row per formatted conversation.

    A null or cut-off conversation is an error; the empty one has no turns. An empty table gives an empty result.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, turns_sha, chars, loss_sha, size = [], [], [], [], []
            for s, starts, ends in zip(b.column("formatted").to_pylist(), b.column("mask_starts").to_pylist(), b.column("mask_ends").to_pylist(), strict=True):
                turns = read_back(s)
                loss = "".join(unescape(s[i:j]) for i, j in zip(starts, ends, strict=True))
                n.append(len(turns))
                turns_sha.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                chars.append(len(loss))
                loss_sha.append(hashlib.sha256(loss.encode()).hexdigest())
                size.append(len(s))
            yield pa.RecordBatch.from_arrays([b.column(tree), pa.array(n, pa.int64()), pa.array(turns_sha, pa.string()), pa.array(chars, pa.int64()), pa.array(loss_sha, pa.string()), pa.array(size, pa.int64())], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(work, f"conv_id {dict(formatted.dtypes)[tree]}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
