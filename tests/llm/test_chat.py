"""Reply trees and the chat template."""

import hashlib
import random

import pytest

from siftlake.llm import chat, queries

TRICKY = ["", "\\", "\\\\", "### ", "###", "</turn>", " </turn>\n", "\\### Assistant: </turn> ok", ": ", "a: b", "\n", "x\\", "\\: ", "é ###\\</turn>"]


def test_template_round_trip():
    rng = random.Random(6)
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", *TRICKY]), "".join(rng.choice(TRICKY) for _ in range(rng.randint(0, 4)))) for _ in range(rng.randint(0, 6))]
        text, starts, ends = chat.format_turns(turns)
        assert chat.read_back(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in zip(starts, ends)] == [t for r, t in turns if r == "assistant"]


def test_cut_off_is_an_error():
    text, _, _ = chat.format_turns([("user", "hello")])
    with pytest.raises(ValueError):
        chat.read_back(text[:-2])


def brute_paths(rows):
    by = {}
    for tree, msg, parent, score in rows:
        by.setdefault(tree, {})[msg] = (parent, score or 0)
    out = set()
    for tree, msgs in by.items():
        parents = {p for p, _ in msgs.values()}
        for leaf in msgs:
            if leaf in parents:
                continue
            path, at, seen = [], leaf, set()
            while at is not None and at in msgs and at not in seen:
                seen.add(at)
                path.append(at)
                at = msgs[at][0]
            if at is None or at not in msgs:
                out.add((tree, leaf, tuple(reversed(path)), round(sum(msgs[m][1] for m in path), 6)))
    return out


def test_paths_match_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for tree in [*range(12), None]:
        n = rng.randint(1, 40)
        for m in range(n):
            deep = rng.random() < 0.7
            parent = None if m == 0 or rng.random() < 0.05 else (m - 1 if deep else rng.randrange(m))
            rows.append((tree, m, parent, rng.choice([None, 1.0, 2.5])))
    rows.append((3, 1000, 999, 1.0))  # its parent does not exist
    rows += [(2, 2000, 2001, 1.0), (2, 2001, 2000, 1.0), (2, 2002, 2001, 1.0)]  # a cycle, and a reply to it
    df = spark.createDataFrame([(*r, "user", "t%s" % r[1], 7) for r in rows], "conv_id long, msg long, parent long, score double, role string, text string, leaf long")
    got = chat.reply_paths(df).collect()
    assert {(r["conv_id"], r["leaf"], tuple(t["msg"] for t in r["turns"]), round(r["path_score"], 6)) for r in got} == brute_paths(rows)
    best = {r["conv_id"]: r for r in chat.reply_paths(df, top=1).collect()}
    for tree, r in best.items():
        assert r["path_score"] == max(x["path_score"] for x in got if x["conv_id"] == tree)


def test_query(spark, tmp_path):
    rows = [(i, t, r, x) for i in range(6) for t, r, x in [(0, "system", None), (1, "user", TRICKY[i]), (2, "assistant", TRICKY[-i]), (3, "assistant", "z" * i)]]
    rows += [(50, t, "assistant" if t % 2 else "user", "turn %d" % t) for t in range(300)] + [(60, 0, None, "no role"), (61, None, "user", "no turn")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in queries.op5_chat(spark, str(tmp_path)).collect()}
    tricky = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)]
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t if t is not None else -1, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_paths(chat.reply_paths(chat.chained(df)))).count() == 0


def test_repeated_rows_long_chains_and_clashing_names(spark):
    rows = [(1, 0, None, 1.0, "user", "a"), (1, 1, 0, 1.0, "assistant", "b"), (1, 1, 0, 1.0, "assistant", "b"), (1, 1, 0, 1.0, "assistant", "zz"), (1, 2, 2, 1.0, "user", "own parent"), (1, None, 0, 5.0, "user", "no id")]
    rows += [(2, i, i - 1 if i else None, 0.5, "user", str(i)) for i in range(3000)]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "conv_id long, msg long, parent long, score double, role string, text string, leaf long, path_rank int").repartition(3)
    got = {(r["conv_id"], r["leaf"]): r for r in chat.reply_paths(df).collect()}
    assert set(got) == {(1, 1), (1, 2), (1, None), (2, 2999)}
    assert [t["text"] for t in got[1, 1]["turns"]] == ["a", "b"] and got[1, 1]["path_score"] == 2.0
    assert [t["text"] for t in got[1, None]["turns"]] == ["a", "no id"] and [got[1, x]["path_rank"] for x in (None, 1, 2)] == [1, 2, 3]
    assert [t["msg"] for t in got[2, 2999]["turns"]] == list(range(3000)) and got[2, 2999]["path_score"] == 1500.0


def test_branching_trees_become_ranked_conversations(spark):
    rows = [(5, 0, None, 0.0, "user", "ask"), (5, 1, 0, 1.0, "assistant", "poor"), (5, 2, 0, 3.0, "assistant", "good"), (5, 3, 2, 1.0, "user", "thanks"), (5, 4, 2, 2.0, "user", "more?"), (5, 5, 4, 0.0, "assistant", "yes")]
    df = spark.createDataFrame(rows, "conv_id long, msg long, parent long, score double, role string, text string")
    made = {r["leaf"]: r["formatted"] for r in chat.format_paths(chat.reply_paths(df, top=2)).collect()}
    assert {k: [x for _, x in chat.read_back(v)] for k, v in made.items()} == {5: ["ask", "good", "more?", "yes"], 3: ["ask", "good", "thanks"]}
    assert {r["n_turns"] for r in chat.digests(chat.format_paths(chat.reply_paths(df, top=2))).collect()} == {3, 4}
