"""Fingerprints, quality, sharding, packing, licences and decontamination against brute force."""

import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from siftlake.llm import decontaminate, licenses, packing, quality, sharding, simhash
from siftlake.session import durable

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fp(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    keys = sorted(set(fps))
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    return {k: find(k) for k in keys}


def test_simhash_matches_brute_force(docs, rows):
    want_fp = [(r[0], brute_fp(r[1])) for r in rows]
    comp = brute_components([f for _, f in want_fp])
    least = {}
    for d, f in want_fp:
        if d is not None:
            least[comp[f]] = min(least.get(comp[f], d), d)
    want = sorted(((d, f"{f:016x}", least[comp[f]]) for d, f in want_fp), key=str)
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == want


def crowd(n=400, seed=3):
    """Fingerprints around a base, some in chains, and unrelated ones."""
    rng = np.random.default_rng(seed)
    base = int(rng.integers(1 << 62))
    fps = {base}
    for _ in range(n):
        x = base
        for b in rng.integers(0, 64, rng.integers(1, 9)):
            x ^= 1 << int(b)
        fps.add(x)
    return sorted(fps | {int(x) for x in rng.integers(0, 1 << 63, 300)})


def same_components(fps, pairs, radius=3):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        assert (a ^ b).bit_count() <= radius
        parent[find(a)] = find(b)
    want, groups, back = brute_components(fps), defaultdict(set), defaultdict(set)
    for f in fps:
        groups[find(f)].add(want[f])
        back[want[f]].add(find(f))
    return all(len(g) == 1 for g in [*groups.values(), *back.values()])


@pytest.mark.parametrize("cell, leaf, most", [(16, 8, 64), (1 << 20, 8, 100), (1 << 20, 32, 1 << 14), (64, 32, 1 << 14), (1, 4, 30)])
def test_links_of_crowded_fingerprints(spark, cell, leaf, most):
    fps = crowd()
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    rows = simhash.link_fingerprints(df, 3, cell, leaf, most).collect()
    assert same_components(fps, [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in rows])


@pytest.mark.parametrize("leaf", [4, 32])
def test_vantage_tree(leaf):
    fps = np.array(crowd(), np.uint64)
    tree = simhash.VantageTree(fps, leaf)
    leaves = [x for x in tree.nodes if not isinstance(x, tuple)]
    assert len(leaves) > 10 and max(map(len, leaves)) <= leaf and sorted(np.concatenate(leaves).tolist()) == list(range(len(fps)))
    a, b = tree.forest(3)
    assert len(a) < 4 * len(fps) and same_components(fps.tolist(), zip(fps[a].tolist(), fps[b].tolist()))
    for radius in (0, 3, 8, 20):
        seen, looked = defaultdict(set), 0
        for q, members in tree.search(np.arange(len(fps)), radius):
            looked += len(q) * len(members)
            for i in q.tolist():
                seen[i] |= set(members.tolist())
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
        assert all(set(np.flatnonzero(near[i]).tolist()) <= seen[i] for i in range(len(fps)))
        assert radius > 3 or looked < 0.9 * len(fps) ** 2  # bounds prune


def brute_stats(text):
    text = text or ""
    w = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        dup += x in seen
        if WORD.search(x):
            seen.add(x)
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    c, mark = Counter(win), [False] * len(w)
    for i, k in enumerate(win):
        if c[k] > 1:
            mark[i : i + 8] = [True] * 8
    rep = sum(mark)
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text), dup, rep, len(w) < 20 or 100 * rep > 30 * len(w)


def test_quality_statistics_match_brute_force(docs, rows):
    got = [tuple(r)[:7] for r in quality.quality(docs).collect()]
    assert sorted(got, key=str) == sorted(((r[0], *brute_stats(r[1])) for r in rows), key=str)
    assert all(not r["kept"] for r in quality.quality(docs).where("base_failed").collect())


def brute_kn(counts):
    """Interpolated modified Kneser-Ney over strings of symbols, straight from the definition."""
    n = quality.ORDER
    tables = [None] * (n + 1)
    tables[n] = dict(counts)
    for k in range(n - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    disc = []
    for k in range(1, n + 1):
        of = [sum(v == i for v in tables[k].values()) for i in (1, 2, 3, 4)]
        y = of[0] / (of[0] + 2 * of[1]) if of[0] else 0.0
        disc.append([0.0] + [min(max((i + 1) - (i + 2) * y * of[i + 1] / of[i], 0.05), i + 0.95) if of[i] else 0.5 for i in range(3)])

    def p(g):
        if not g:
            return 1 / 64
        k = len(g)
        same = {h: v for h, v in tables[k].items() if h[:-1] == g[:-1]}
        total = sum(same.values())
        c = tables[k].get(g, 0)
        gamma = sum(disc[k - 1][min(v, 3)] for v in same.values()) / total
        return (c - disc[k - 1][min(c, 3)]) / total + gamma * p(g[1:])

    return p


def test_kneser_ney_matches_its_definition():
    text = "abracadabra abra cadabra barbara " * 2
    g = quality.grams(quality.classes_of(text))
    keys, n = np.unique(g, return_counts=True)
    unpack = lambda k: tuple(int(k) >> (6 * i) & 63 for i in (3, 2, 1, 0))
    p = brute_kn({unpack(k): int(c) for k, c in zip(keys, n)})
    m = quality.Model.load(quality.Model(keys, n).dump())
    assert np.allclose(m.score(g[:20]), [np.log2(p(unpack(k))) for k in g[:20]], atol=1e-4)
    unseen = quality.grams(quality.classes_of("zzqx"))
    assert (m.score(unseen) < -5).all()


def test_scores_leave_the_document_out(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abc "), 60)) for _ in range(6)] + ["zzab zz", "abcabcabd"]
    grams = [quality.grams(quality.classes_of(t)) for t in texts]
    unpack = lambda k: tuple(int(k) >> (6 * i) & 63 for i in (3, 2, 1, 0))
    counts = Counter(unpack(k) for g in grams for k in g)
    keys, n = np.unique(np.concatenate(grams), return_counts=True)
    model = quality.Model(keys, n)
    levels = {4: dict(counts)}
    for k in (3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    p = brute_kn(counts)

    def gamma(ctx, k):
        same = {h: v for h, v in levels[k].items() if h[:-1] == ctx}
        if not same:
            return 1.0
        of = [sum(v == i for v in levels[k].values()) for i in (1, 2, 3, 4)]
        y = of[0] / (of[0] + 2 * of[1]) if of[0] else 0.0
        cut = [0.0] + [min(max((i + 1) - (i + 2) * y * of[i + 1] / of[i], 0.05), i + 0.95) if of[i] else 0.5 for i in range(3)]
        return sum(cut[min(v, 3)] for v in same.values()) / sum(same.values())

    for g in grams:
        own = Counter(unpack(k) for k in g)
        alone = {h for h in own if counts[h] == own[h]}  # no other text has it
        by_level = {4: alone}
        for k in (3, 2, 1):
            by_level[k] = {h[1:] for h in by_level[k + 1] if all(f in by_level[k + 1] for f in levels[k + 1] if f[1:] == h[1:])}
        keys, n = np.unique(g, return_counts=True)
        got = model.score(keys, n)
        for key, value in zip(keys, got):
            h, want = unpack(key), 0.0
            for k in (4, 3, 2, 1):
                if h in levels[k] and h not in by_level[k]:
                    want += np.log2(p(h))
                    break
                want += np.log2(gamma(h[:-1], k))
                h = h[1:]
            else:
                want -= np.log2(64)
            assert abs(want - value) < 1e-3
    df = spark.createDataFrame([(i, t + " " + " ".join(texts), "en" if i % 2 else "fr") for i, t in enumerate(texts * 4)] + [(None, None, None), (99, "", "en")], "doc_id long, text string, lang string").repartition(3)
    near = sorted(map(str, map(tuple, quality.quality(df).collect())))
    monkeypatch.setattr(quality, "MODEL_BYTES", 0)
    monkeypatch.setattr(quality, "DEAL_CHARS", 1500)
    assert sorted(map(str, map(tuple, quality.quality(df).collect()))) == near


def test_perplexity_rejects_foreign_text(spark):
    rng = np.random.default_rng(0)
    word = lambda alphabet: "".join(rng.choice(list(alphabet), rng.integers(2, 8)))
    vocab = [word("etaoinshr") for _ in range(300)]
    rows = [(i, " ".join(rng.choice(vocab, 120)), "en") for i in range(200)] + [(900, " ".join(word("qzxjkvwbygpñüß#%&!?123-éèçöäàâ") for _ in range(120)), "en")]
    got = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got.pop(900) and all(got.values())


@pytest.mark.parametrize("lang, alphabet, least", [("ru", "абвгдежзиклмнопрстуфхцчшыэюя", 3), ("el", "αβγδεζηθικλμνξοπρστυφχψω", 3), ("pl", "ąćęłńśźżğšőțđħ", 3), ("zh", "".join(map(chr, range(0x4E00, 0x5200))), 1), ("other", "".join(map(chr, range(0x20000, 0x20100))), 1)])
def test_perplexity_rejects_random_letters_of_any_script(spark, lang, alphabet, least):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list(alphabet), rng.integers(least, 8)))
    vocab = [word() for _ in range(300)]
    rows = [(i, " ".join(rng.choice(vocab, 120)), lang) for i in range(200)] + [(900, " ".join(word() for _ in range(120)), lang)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got.pop(900) and all(got.values())


def test_symbols_keep_code_points():
    of = lambda t: quality.classes_of(t)[quality.ORDER - 1 :].tolist()
    assert len(set(of("łšğжλ漢한ह𠀀"))) == 9 and of("ŁЖΛ") == of("łжλ")
    g = quality.grams(quality.classes_of("漢字かな"))
    assert len(set(g.tolist())) == 4 and quality.tail(g[-1:], 4)[0] == quality.grams(np.r_[np.zeros(1, np.uint32), quality.classes_of("字かな")[3:]])[0]


def test_sharding(docs, rows, spark):
    big = docs.unionByName(spark.range(3000).selectExpr("id + 10000 as doc_id", "if(id % 3 = 0, 'the very same text', concat('text ', id, repeat('x', cast(id % 90 as int)))) as text", "'en' as lang", "'s' as source", "1L as n_chars", "0.0D as score", "1L as h"))
    got = sharding.shard_by_bytes(big, 16, 4).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in big.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots, load = defaultdict(list), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert set(slots) <= set(range(16)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    total = sum(load.values())
    assert max(load.values()) - min(load[s] for s in range(16)) < 0.02 * total / 16 + 2 * max(r["size"] for r in got)
    assert {r["law"] for r in got} == {"bytes"} and all(r["grown_shard"] is None for r in got)


@pytest.mark.parametrize("ranges, tolerance", [(16, 0.002), (64, 0.05), (2, 0.0)])
def test_splitters_against_sorted_keys(spark, ranges, tolerance):
    df = spark.range(2500).selectExpr("xxhash64(if(id % 4 = 0, 0, id)) as _h", "xxhash64(id, 'id') as _g", "1 + id % 97 as size")
    rows = sorted(((r["_h"] % (1 << 64), r["_g"] % (1 << 64)), r["size"]) for r in df.collect())
    total = sum(n for _, n in rows)
    splitters = [sharding._pair(k) for k in sharding.find_splitters(df, ranges, tolerance)]
    assert len(splitters) == ranges - 1 and splitters == sorted(splitters)
    for k, cut in enumerate(splitters, 1):
        below = sum(n for key, n in rows if key < cut)
        assert abs(below - total * k / ranges) <= max(total / ranges * tolerance, 97)


def test_packing(docs, rows):
    encode = packing.encoder("byte_bpe_50k.json")
    got = packing.pack_related(docs, with_ids=True).collect()
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], np.uint16)
        assert len(ids) == r["length"] and zlib.crc32(ids.astype("<u4").tobytes()) == r["ids_crc32"]
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["start"], ids.tolist(), r["doc_tokens"]))
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append([*(encode(r[1]) if r[1] else []), 0])
    for doc, pieces in by_doc.items():
        assert all(t == len(want[doc][0]) for _, _, t in pieces)
        if len(want[doc]) == 1:
            assert sum((ids for _, ids, _ in sorted(pieces)), []) == want[doc][0]
        else:
            assert sum(len(ids) for _, ids, _ in pieces) == len(want[doc]) * len(want[doc][0])
    assert set(by_doc) == set(want)


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json"])
def test_added_tokens_as_in_the_tokenizer(name):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    contract = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    encode = packing.encoder(name)
    assert list(encode("hello <|endoftext|> world")) == [31373, 220, 50256, 995]
    for text in ("<|endoftext|>", "a<|endoftext|>b", "x \n <|endoftext|><|endoftext|>\n  y", "<|endoftext", "<|ENDOFTEXT|> é漢", "no control string"):
        assert list(encode(text)) == contract.encode(text, add_special_tokens=False).ids


def brute_walk(n, edges):
    near = defaultdict(dict)
    for a, b, w in edges:
        near[a][b] = near[b][a] = w
    out = []
    for start in sorted(range(n), key=lambda v: (len(near[v]), v)):
        v = start
        while v is not None and v not in out:
            out.append(v)
            left = [u for u in near[v] if u not in out]
            v = min(left, key=lambda u: (-near[v][u], len(near[u]), u)) if left else None
    return out


def test_walk_matches_its_definition():
    rng = np.random.default_rng(4)
    for n, m in ((0, 0), (1, 0), (2, 1), (3, 2), (50, 120), (80, 60)):
        edges = {tuple(sorted(map(int, rng.choice(n, 2, replace=False)))): np.float32(rng.integers(1, 9)) for _ in range(m)}
        a, b, w = (np.array([x[i] for x in [(*k, v) for k, v in edges.items()]]) for i in range(3))
        got = packing.walk(n, a.astype(np.int64), b.astype(np.int64), w.astype(np.float32))
        assert got == brute_walk(n, [(*k, v) for k, v in edges.items()]) and sorted(got) == list(range(n))


def test_neighbour_recall_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)
    index = packing.fit_index(docs, "byte_bpe_50k.tiktoken", sample=500, per_cell=40)
    assert len(index.centroids) > 15
    tokens = durable(packing.tokenise(docs, "byte_bpe_50k.tiktoken", index), "tokens")
    y = {r["vid"]: np.frombuffer(r["y"], np.float32) for r in tokens.collect()}
    vids, m = np.array(list(y)), np.stack(list(y.values()))
    for tile in (packing.TILE, 16):
        got = {r["vid"]: np.frombuffer(r["near"], packing._NEAR) for r in packing.neighbours(tokens, tile=tile).collect()}
        assert set(got) == set(y)
        found = total = 0
        for i, v in enumerate(vids):
            sim = m @ m[i]
            sim[i] = -2
            best = np.sort(sim)[-packing.NEIGHBOURS :]
            found += int((got[v]["s"] >= best[0] - 1e-5).sum())
            total += packing.NEIGHBOURS
            assert len(set(got[v]["v"].tolist())) == packing.NEIGHBOURS and v not in got[v]["v"] and (np.diff(got[v]["s"]) <= 0).all()
        assert found >= 0.9 * total, found / total


def test_related_documents_share_sequences(spark):
    rng = np.random.default_rng(2)
    topics = [["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(30)] for _ in range(6)]
    rows = [(i, " ".join(rng.choice(topics[i % 6], 60))) for i in range(240)]
    got = packing.pack_related(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    in_seq = defaultdict(list)
    for r in got:
        in_seq[r["sequence_id"]].append(r["doc_id"] % 6)
    assert sum(len(set(x)) == 1 for x in in_seq.values()) > 0.7 * len(in_seq)


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [(1, mit), (2, "Some text.\nLicensed under the Apache License, Version 2.0.\nmore"), (3, "the license plate"), (4, None), (5, ""), (6, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."), (6, "x. Released under the MIT License."), (7, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = sorted((r["doc_id"], r["license"], r["n_sentences"]) for r in licenses.scan_licenses(df).collect())
    assert got == [(1, "MIT", 2), (2, "Apache-2.0", 1), (6, "CC-BY-NC-4.0", 1), (6, "MIT", 1), (6, "MIT", 1), (7, "CC-BY-NC-4.0", 2)]
    assert licenses.scan_licenses(df.where("false")).count() == 0


def test_licenses_over_wrapped_lines(spark):
    known = lambda k, i=0: licenses.SENTENCES[k][i]
    wrap = lambda k, width=60, lead="", first="": textwrap.fill(known(k), width, initial_indent=first or lead, subsequent_indent=lead)
    mit = "MIT License\n\nCopyright (c) 2020 A\n\n" + "\n\n".join(wrap(k) + "." for k in ("MITPerm", "MITNotice", "AsIsSoftware"))
    apache = "# Licensed under the Apache License, Version 2.0 (the \"License\");\r\n# you may not use this file except in compliance with the License.\r\n# You may obtain a copy of the License at\r\n#\r\n#     http://www.apache.org/licenses/LICENSE-2.0\r\n#\r\n" + "\r\n".join(wrap(k, 70, "# ").replace("\n", "\r\n") + "." for k in ("ApacheAsIs", "ApacheLang"))
    bsd = wrap("BSDRedist") + ":\n\n" + "\n\n".join(wrap(k, 50, "   ", f"{i}. ") + "." for i, k in enumerate(("BSDSource", "BSDBinary"), 1))
    gpl = "/*\n" + wrap("GPLFree", 50, " * ").replace("free software", "free\n * software").capitalize() + ".\n */"
    loose = "no full stop here\nReleased under the MIT License\nand no full stop here"
    rows = [(1, mit), (2, apache), (3, bsd), (4, gpl), (5, loose), (6, "all rights\n\nreserved"), (7, "it is said: all rights reserved\nby them"), (8, "All rights\nreserved"), (9, "public\n\ndomain. licen")]
    got = sorted((r["doc_id"], r["license"], r["sentence_ids"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [(1, "MIT", "MITRef;MITPerm;MITNotice;AsIsSoftware"), (2, "Apache-2.0", "ApacheRef2;ApacheUse;ApacheCopy;ApacheAsIs;ApacheLang"), (3, "BSD-2-Clause", "BSDRedist;BSDSource;BSDBinary"), (4, "GPL-3.0-or-later", "GPLFree"), (5, "MIT", "MITRef"), (8, "proprietary", "AllRights")]
    assert got == want


def test_licenses_as_in_sql_and_without_losses(spark):
    import duckdb
    import pandas as pd

    known = licenses.SENTENCES
    bsd = "Copyright (c) 2001 X\nAll rights reserved.\n\n" + ".\n\n".join(textwrap.fill(x, 60) for x in [known["BSDRedist"][0], known["BSDSource"][0], known["BSDBinary"][0]]) + ".\n\n3. "
    endorse = textwrap.fill("Neither the names of A, B Labs and C nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", 50)
    tail = ".\n\n" + textwrap.fill(known["BSDDisclaim"][0], 70).upper() + ".  " + textwrap.fill(known["BSDLiable"][0], 70).upper() + ".\n"
    rows = [(1, bsd + endorse + tail), (2, bsd + "other" + tail), (3, "All  rights\treserved."), (4, "This work is dedicated to the public  domain."), (5, "All rights reserved.\nMIT License\n"), (6, None), (7, ""), (None, "isc license"), (None, "isc license"), (8, "All rights reserved. x.\nall rights reserved"), (9, "word " * 5000 + ". released under the\nMIT license.\n" + "word\n" * 3000), (10, "licensed under the apache license version 2.0\nthe license")]
    got = sorted(map(tuple, licenses.scan_licenses(spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, license string, rule_no int")).collect()), key=str)
    c = duckdb.connect()
    c.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    want = sorted(((None if pd.isna(r[0]) else int(r[0]), *r[1:]) for r in c.execute(licenses.sql()).fetchall()), key=str)
    assert got == want
    assert sorted((str(r[0]), r[1]) for r in got) == sorted([("1", "BSD-3-Clause"), ("2", "BSD-2-Clause"), ("3", "proprietary"), ("4", "CC0-1.0"), ("5", "MIT"), ("None", "ISC"), ("None", "ISC"), ("8", "proprietary"), ("9", "MIT"), ("10", "Apache-2.0")])


def brute_overlaps(docs, items):
    norm = lambda t: [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]
    out = set()
    for d, t in docs:
        w = norm(t)
        for i, s in items:
            b = norm(s)
            if len(b) < 5:
                continue
            for at in range(-len(b) + 1, len(w)):
                hit = [0 <= at + j < len(w) and w[at + j] == b[j] for j in range(len(b))]
                n = min(13, len(b))
                need = 11 if len(b) >= 13 else len(b)
                if any(sum(hit[j : j + n]) >= need for j in range(len(b) - n + 1)):
                    out.add((d, i))
    return out


def test_decontamination_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vocab = ["w%d" % i for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab, n))) for i, n in enumerate([13, 14, 25, 40, 7, 5, 4, 12])] + [(90, None), (91, "")]
    docs = [(0, None), (1, ""), (2, "w1 w2")]
    for k in range(60):
        w = list(rng.choice(vocab, 60))
        b = (items[k % 8][1]).split()
        for _ in range(int(rng.integers(0, 5))):
            b[int(rng.integers(0, len(b)))] = "other"
        cut = int(rng.integers(0, 4))
        at = int(rng.integers(0, 40))
        w[at : at + len(b) - cut] = b[cut:]
        docs.append((k + 10, ("... " if k % 2 else "") + ", ".join(w).upper()))
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, b).collect()}
    assert got == brute_overlaps(docs, items)
    monkeypatch.setattr(decontaminate, "BROADCAST_HITS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, b).collect()} == got
    assert decontaminate.contaminated(d.where("false"), b).count() == 0
    assert decontaminate.contaminated(d, b.where("false")).count() == 0


def test_empty_tables(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert quality.quality(empty).count() == 0
    assert sharding.shard_by_bytes(empty).count() == 0
    assert packing.pack_related(empty).count() == 0


@pytest.mark.parametrize("block", [3, 40, 1000])
def test_paths_cross_blocks(spark, block):
    rng = np.random.default_rng(5)
    # a chain whose neighbours all lie in different cells, and a random graph beside it
    near = {v: [(u, 0.9) for u in (v - 1, v + 1) if 0 <= u < 90] for v in range(90)}
    near |= {v: [(int(u), float(np.float32(rng.random()))) for u in rng.choice(np.arange(100, 200), 4, replace=False) if u != v] for v in range(100, 200)}
    rows = [(v, v % 7, float(v), np.array(x, packing._NEAR).tobytes()) for v, x in near.items()]
    got = defaultdict(list)
    for r in packing.paths(spark.createDataFrame(rows, "vid long, home int, p float, near binary").repartition(3), block).collect():
        got[r["path"]].append(((r["rank"], r["at"]), r["vid"]))
    found = [[v for _, v in sorted(x)] for x in got.values()]
    assert sorted(v for x in found for v in x) == sorted(near)
    chain = [x for x in found if x[0] < 100]
    assert len(chain) == 1 and chain[0] in (list(range(90)), list(range(89, -1, -1)))
    linked = {frozenset((v, u)) for v, x in near.items() for u, _ in x}
    assert all(frozenset(e) in linked for x in found for e in zip(x, x[1:]))
    ends = [(v, i) for i, x in enumerate(found) for v in (x[0], x[-1])]
    assert not [1 for v, i in ends for u, j in ends if i != j and frozenset((v, u)) in linked]
