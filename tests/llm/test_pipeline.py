"""The pipeline, stage by stage, against a single-process version."""

import random
from collections import Counter, defaultdict

import numpy as np
from test_documents import brute_overlaps, brute_stats

import corpus_pipeline as P
from siftlake.llm import packing, quality, simhash
from siftlake.session import durable


def make(tmp_path, spark):
    rng = random.Random(11)
    vocab = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, prose(20)) for i in range(5)]
    passage = prose(60)
    texts = [prose(rng.randint(25, 300)) for _ in range(60)]
    texts += [texts[0], texts[1], texts[2] + " " + vocab[0], "too short", None, "", (prose(12) + "\n") * 9, "Zq#x " * 3 + " ".join("".join(rng.choice("qzxjkvw#%&ß123") for _ in range(6)) for _ in range(90))]
    texts += [prose(40) + " " + passage + " é " + prose(30) for _ in range(4)] + [prose(30) + " " + items[2][1] + ". " + prose(40), prose(50) + " " + items[4][1].upper()]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return {i: t for i, t, *_ in rows}, items


def brute_quality(docs):
    grams = {i: np.unique(quality.grams(quality.classes_of(t)), return_counts=True) for i, t in docs.items() if t}
    keys, at = np.unique(np.concatenate([k for k, _ in grams.values()]), return_inverse=True)
    model = quality.Model(keys, np.bincount(at, np.concatenate([n for _, n in grams.values()])).astype(np.int64))
    score = {i: -float((model.score(k, n) * n).sum()) / len(docs[i]) for i, (k, n) in grams.items()}
    ok = {i for i, t in docs.items() if not brute_stats(t)[-1]}
    v = np.sort([np.floor(score[i] * 1000) / 1000 for i in ok])
    q1, q3 = (v[int(np.ceil(q * len(v))) - 1] for q in (0.25, 0.75))
    w = max(4 * (q3 - q1), 0.6)
    return {i: docs[i] for i in ok if q1 - w - 9 / len(docs[i]) ** 0.5 <= score[i] <= q3 + w + 9 / len(docs[i]) ** 0.5}


def brute_repeats(docs, span=100):
    seen, out = set(), {}
    for i in sorted(docs):
        raw = (docs[i] or "").encode()
        mask = np.zeros(len(raw), bool)
        for p in range(len(raw) - span + 1):
            if raw[p : p + span] in seen:
                mask[p : p + span] = True
            seen.add(raw[p : p + span])
        keep, at = [], 0
        for ch in docs[i] or "":  # a character goes only as a whole
            n = len(ch.encode())
            if not mask[at : at + n].all():
                keep.append(ch)
            at += n
        out[i] = "".join(keep)
    return out


def shingles(t, n=5):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute_near(docs, least=0.8):
    sets, parent = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if len(a & b) >= least * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: docs[i] for i in ids if find(i) == i}


def test_stages_and_run(spark, tmp_path):
    docs, items = make(tmp_path, spark)
    got = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = docs
    for name, stage in P.STAGES[:-1]:
        got = durable(stage(spark, got, str(tmp_path)), name)
        assert got.columns == P.COLUMNS
        if name == "quality":
            want = brute_quality(want)
            assert len(want) < len(docs) and 67 not in want
        elif name == "simhash":
            want = brute_near(want)
        elif name == "suffix":
            want = brute_repeats(want)
        else:
            bad = {d for d, _ in brute_overlaps(list(want.items()), items)}
            assert bad
            want = {i: t for i, t in want.items() if i not in bad}
        assert {r["doc_id"]: r["text"] for r in got.collect()} == want, name
        assert all(r["n_chars"] == len(r["text"]) for r in got.collect())
    pieces = defaultdict(list)
    for r in P.run(spark, str(tmp_path)).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    encode = packing.encoder(packing.pack_related.__defaults__[0])
    assert set(pieces) == set(want)
    for i, parts in pieces.items():
        assert sum(n for _, n, _ in parts) == len(encode(want[i])) + 1 == parts[0][2]


def test_nulls_copies_and_empty_tables(spark, tmp_path):
    _, items = make(tmp_path, spark)
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(n))
    good = [prose(120) for _ in range(5)]
    twice = good[3] + " " + good[4] + "\n" + good[4]
    leak = prose(50) + " " + items[1][1] + " " + prose(50)
    rows = [(None, "too short"), (None, good[0]), (None, good[0]), (None, good[1]), (7, good[1]), (7, good[2]), (8, good[2]), (8, good[2]), (None, twice), (9, leak), (None, leak), (9, good[4] + " x"), (None, None), (3, None), (4, "")]
    made = spark.createDataFrame([(i, t, None, "s", None, "clash", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, th string, _k int").repartition(3)
    run = lambda name: Counter((r["doc_id"], r["text"]) for r in dict(P.STAGES)[name](spark, made, str(tmp_path)).collect())
    every = Counter(rows)
    assert run("quality") == Counter({k: n for k, n in every.items() if k[1] and len(k[1]) > 50 and k[1] != twice})
    first = [(None, "too short"), (None, good[0]), (7, good[1]), (7, good[2]), (None, twice), (9, leak), (9, good[4] + " x"), (3, None)]
    assert run("simhash") == Counter(first)
    cut = run("suffix")
    assert sum(cut.values()) == len(rows) and cut[None, None] == 1 and cut[3, None] == 1
    # rows without an id come first: what they repeat within the row goes, and so do later copies with an id
    assert cut[8, ""] == 2 and cut[7, ""] == 1 and (None, twice) not in cut and any(k[0] is None and k[1] and k[1].startswith(good[3]) and len(k[1]) < len(twice) for k in cut)
    assert run("decontamination") == Counter({k: n for k, n in every.items() if k[1] != leak})
    sizes = [(r["doc_id"], r["doc_tokens"]) for r in dict(P.STAGES)["packing"](spark, made, str(tmp_path)).where("start = 0").collect()]
    assert len(sizes) == len(rows) and sum(i is None for i, _ in sizes) == 7 and sum(n == 1 for _, n in sizes) == 3
    for name, stage in P.STAGES:
        assert stage(spark, made.where("false"), str(tmp_path)).count() == 0, name


def test_order():
    assert [s for s, _ in P.STAGES] == ["quality", "simhash", "suffix", "decontamination", "packing"]


def test_near_copies_go_by_jaccard_of_five_words(spark, tmp_path):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    sets = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(len(w) - 4)}
    jaccard = lambda a, b: len(sets(a) & sets(b)) / len(sets(a) | sets(b))
    texts, copies, seen = [], set(), []
    for k in range(40):
        w = [rng.choice(vocab) for _ in range(300)]
        v = list(w)
        for i in range(1 + k % 8):  # each replaced word takes five shingles
            v[7 + 35 * i] = "other%d" % i
        texts += [" ".join(w), " ".join(v)]
        seen.append(jaccard(*texts[-2:]))
        if seen[-1] >= 0.8:
            copies.add(2 * k + 1)
    assert min(seen) < 0.8 and sum(0.8 <= j < 0.95 for j in seen) >= 20
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in dict(P.STAGES)["simhash"](spark, docs, str(tmp_path)).collect()}
    assert got == set(range(80)) - copies


def test_similar_groups_match_brute_force(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    texts = [None, "", " ", "one two", "One  TWO", "a b c d e"]
    for n in (22, 40, 150, 400):
        base = [rng.choice(vocab) for _ in range(n)]
        for _ in range(60):
            w = list(base)
            for _ in range(rng.randint(0, max(1, n // 40))):
                w[rng.randrange(n)] = rng.choice(vocab)
            texts.append(" ".join(w))
        for k in range(40):  # a chain of texts that move on: neighbours are similar, the ends are not
            base = base[1:] + [rng.choice(vocab)]
            texts.append(" ".join(base))
    rows = dict(enumerate(texts))
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"] for r in simhash.without_near_copies(docs).collect()}
    assert got == set(brute_near(rows)) and len(got) < 120


def test_bitmaps_never_understate_what_sets_share():
    rng = np.random.default_rng(8)
    for n in (0, 1, 20, 300, 4000):
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        y = np.concatenate([x[: n // 2], rng.integers(0, 1 << 63, n // 3).astype(np.uint64)])
        a, b = simhash.bitmap(x).view(np.uint64), simhash.bitmap(y).view(np.uint64)
        both, w = int(np.bitwise_count(a & b).sum()), [int(np.bitwise_count(m).sum()) for m in (a, b)]
        assert both + min(len(x) - w[0], len(y) - w[1]) >= n // 2


def test_crowd_of_copies_that_are_no_copies_of_each_other(spark, monkeypatch):
    rng = random.Random(12)
    base = ["w%d" % i for i in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for at in rng.sample(range(150), 3):  # each edit is one of a few hundred, so that no shingle is in one text only
            w[at] = "w%d" % ((at * 7 + rng.randrange(2)) % 150)
        rows.append((i, " ".join(w)))
    made, whole = [], simhash.durable_counted

    def counted(df, name="part"):
        out = whole(df, name)
        made.extend([out[1]] * (name == "pairs"))
        return out

    monkeypatch.setattr(simhash, "durable_counted", counted)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["_k"]["id"]: r["component"] for r in simhash.similar_groups(d).collect()}
    sets = [set(zip(*[t.split()[i:] for i in range(5)])) for _, t in rows]
    label = list(range(120))
    for i in range(120):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = label[i], label[j]
                label = [y if c == x else c for c in label]
    assert len({(a, got[i]) for i, a in enumerate(label)}) == len(set(label)) == len(set(got.values()))
    assert made[-1] < 2 * len(rows)
