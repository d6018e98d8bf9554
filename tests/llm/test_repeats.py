"""The two exact substring operators against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from siftlake.llm import repeats, substrings, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST = -(1 << 63)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def distinct(rows):
    return sorted({(LEAST if r[0] is None else r[0], r[1] or "") for r in rows})


def brute_bytes(rows, span):
    seen, out = {}, []
    for doc, text in distinct(rows):
        raw = text.encode()
        mask = np.zeros(len(raw), bool)
        for i in range(len(raw) - span + 1):
            w = raw[i : i + span]
            if w in seen:
                mask[i : i + span] = True
            seen.setdefault(w, doc)
        kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
        spans = int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum())
        out.append((None if doc == LEAST else doc, len(raw), int(mask.sum()), spans, sha(kept)))
    return sorted(out, key=str)


def brute_words(rows, span):
    first, all_ = {}, []
    for doc, text in distinct(rows):
        words = WORD.findall(text)
        all_.append((doc, words))
        for i in range(len(words) - span + 1):
            k = tuple(words[i : i + span])
            first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, words in all_:
        mask = [False] * len(words)
        for i in range(len(words) - span + 1):
            if first[tuple(words[i : i + span])] < doc:
                mask[i : i + span] = [True] * span
        out.append((None if doc == LEAST else doc, len(words), sum(mask), sha(" ".join(w for w, m in zip(words, mask) if not m).encode())))
    return sorted(out, key=str)


@pytest.mark.parametrize("span", [100, 37])
def test_bytes_match_brute_force(docs, rows, span):
    got = suffixes.byte_repeats(docs, span).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_bytes(rows, span)


@pytest.mark.parametrize("crowd", [1, 4096])
def test_bytes_hot_anchors_match_brute_force(docs, rows, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    monkeypatch.setattr(repeats, "HOT", 1)
    got = suffixes.byte_repeats(docs, 100).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_bytes(rows, 100)


def test_kept_text_is_valid(docs):
    for r in suffixes.byte_repeats(docs, 100, keep_text=True).where("n_removed > 0").collect():
        assert r["kept"] is not None and "�" not in r["kept"]


@pytest.mark.parametrize("span", [50, 13])
def test_words_match_brute_force(docs, rows, span):
    got = substrings.word_substrings(docs, span).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_words(rows, span)


def test_empty_tables(empty):
    assert suffixes.byte_repeats(empty, 100).count() == 0
    assert substrings.word_substrings(empty, 50).count() == 0


def test_later_windows_on_random_texts():
    rng = random.Random(2)
    for span in (3, 6, 17):
        for _ in range(60):
            ctx = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 8))]
            seen, want = set(), []
            for c in ctx:
                want.append([i for i in range(len(c) - span + 1) if c[i : i + span] in seen or seen.add(c[i : i + span])])
            assert [x.tolist() for x in suffixes.later_windows(ctx, span)] == want


def test_every_window_has_one_anchor():
    rng = np.random.default_rng(1)
    for n in (0, 3, 10, 200):
        h = rng.integers(0, 6, n).astype(np.uint64) << np.uint64(30)
        at, lo, hi = repeats.anchors(h, 5)
        starts = [s for a, x, y in zip(at, lo, hi) for s in range(x, y + 1)]
        assert starts == list(range(max(n - 4, 0)))
        for a, x, y in zip(at, lo, hi):
            assert all(h[s : s + 5].argmin() == a - s for s in range(x, y + 1))
