"""Dataset-level operators, sources and sinks."""

import bz2
import glob
import gzip
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake import api
from siftlake.models import classifier
from siftlake.operators import corpus, dedup
from siftlake.operators.components import connected_components
from siftlake.plans import catalogue
from siftlake.session import durable_counted, memoised
from siftlake.sources import files, warc
from siftlake.streaming import events


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def texts(df, key="doc_id"):
    return {r[key]: r["text"] for r in df.collect()}


def test_line_dedup(spark):
    d = docs(spark, "shared\n", "shared\n", "- home\n- menu\nonly here\n", "- home\n- menu\nlast", "twice\nmid\ntwice\n", "", None, "own\n\nblank\n", "\n")
    got = texts(dedup.exact_line_dedup(d))
    assert got == {0: "", 1: "", 2: "only here\n", 3: "last", 4: "mid\n", 5: "", 6: None, 7: "own\nblank\n", 8: ""}
    left = [line for t in got.values() if t for line in t.rstrip("\n").split("\n")]
    assert len(left) == len(set(left))


def test_document_dedup(spark):
    assert texts(dedup.exact_document_dedup(docs(spark, "b", "a", "b", None, None))) == {0: "b", 1: "a", 3: None, 4: None}


LICENCE = "permission is granted free of charge to any person who obtains a copy of these files to use copy change merge publish and sell copies of them as long as this notice is kept in all copies or large parts of the files and no claim is made against their authors for any damage that comes from their use in any way at all "


def test_minhash(spark):
    near = LICENCE.replace("free of charge", "without charge").replace(" to ", "  to\n", 3)
    d = docs(spark, LICENCE, near, "something else entirely that has nothing to do with it", LICENCE, "tiny", "", None)
    p = dedup.MinHash(100, 25, 5, 0.8)
    assert set(texts(dedup.minhash_dedup(d, p))) == {0, 2, 4, 5, 6}
    assert texts(dedup.minhash_dedup(d.repartition(3), p)) == texts(dedup.minhash_dedup(d, p))
    for r in dedup.near_duplicate_pairs(d, p).collect():
        assert r["a"] < r["b"] and r["jaccard"] >= 0.8
    with pytest.raises(ValueError):
        dedup.MinHash(10, 3)


def most_rows(spark, df, metric="numOutputRows"):
    """The rows of ``df``, and the most that an operator of its plan made."""
    rows, seen, todo = df.collect(), [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        inner = [node.finalPhysicalPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("StageExec") and "Query" in kind else []
        made = node.metrics().get(metric)
        seen += [made.get().value()] if made.isDefined() else []
        kids = node.children()
        todo += inner + [kids.apply(i) for i in range(kids.size())]
    return rows, max(seen)


def test_signatures_make_no_row_a_shingle(spark, tmp_path):
    d = docs(spark, *[" ".join(f"w{(i * 31 + j * j) % 997}" for j in range(400)) for i in range(20)], "Two words", " \n", None)
    d = d.union(spark.createDataFrame([(20, "other words of the same id")], d.schema))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    rows, most = most_rows(spark, catalogue.minhash_signature(spark, str(tmp_path)))
    assert len(rows) == 21 and most <= 24
    pair = next(r for r in rows if r["doc_id"] == 20)
    assert pair["h3"] == min(hashlib.md5(f"3|{s}".encode()).hexdigest() for s in ("two words", "other words of the same", "words of the same id"))


def near_copies(spark):
    """Texts with copies that differ in some words, and the exact pairs of them."""
    base = [[f"w{(i * 131 + j * j) % 9973}" for j in range(300)] for i in range(12)]
    own = [" ".join(w if (j + 7 * k) % (160 // (k + 1)) else f"x{i}{k}" for j, w in enumerate(ws)) for i, ws in enumerate(base) for k in range(6)]
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for t in own]
    near = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(own)) for b in range(a + 1, len(own))}
    return docs(spark, *own), near


def test_near_pairs_meet_outside_python(spark):
    d, near = near_copies(spark)
    found = dedup.near_duplicate_pairs(d)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r["a"], r["b"]): r["jaccard"] for r in found.collect()}
    assert got == {k: v for k, v in near.items() if v >= 0.8} and 0 < len(got) < sum(v >= 0.5 for v in near.values())


def test_links_are_written_once(spark):
    d, near = near_copies(spark)
    p = dedup.MinHash()
    links = dedup._links(dedup._banded(d, p, "doc_id", "text"), p)
    assert "Join" not in links._jdf.queryExecution().executedPlan().toString()
    assert {(r["a"], r["b"]) for r in links.collect()} <= {k for k, v in near.items() if v >= 0.8}


def test_kept_documents_are_not_shuffled(spark, tmp_path):
    d, near = near_copies(spark)
    d.write.parquet(f"{tmp_path}/d")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = dedup.minhash_dedup(spark.read.parquet(f"{tmp_path}/d"))
        ids = {r["doc_id"] for r in kept.collect()}
        gone = 72 - len(ids)
        _, most = most_rows(spark, kept.select("doc_id"), "shuffleRecordsWritten")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < gone and most <= gone + 3
    left = {min(k) for k, v in near.items() if v >= 0.8 and set(k) <= ids}
    assert not left


def test_bits_of_keys_hold_for_every_key(spark):
    keys, others = ([r["h"] for r in spark.range(a, b).select(F.xxhash64("id").alias("h")).collect()] for a, b in ((0, 3000), (3000, 9000)))
    for most, few in ((1 << 27, 200), (1 << 12, 4000)):
        test = dedup._among(spark.range(3000), 3000, most)
        assert test(np.array(keys)).all() and test(np.array(others)).sum() < few
    assert not dedup._among(spark.range(0), 0)(np.array(keys)).any()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (5, 5), (300, 300), (None, 4)] + [(1000, 1001 + i) for i in range(50)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100 and got[300] == 300 and got[1040] == 1000
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_training_reads_only_the_chosen_texts(spark, monkeypatch):
    d = docs(spark, *[f"{'good' if i % 3 else 'bad'} text {i}" for i in range(500)], None)
    labels = d.select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 3 != 0).cast("int").alias("quality"))
    taken, fit = [], classifier.Pipeline.fit
    monkeypatch.setattr(classifier.Pipeline, "fit", lambda self, df: taken.append(df) or fit(self, df))
    want = [(r["doc_id"], r["text"] or "") for r in d.where("doc_id % 7 <> 0").orderBy(F.xxhash64("doc_id")).limit(60).collect()]
    classifier.fit(d, labels, "quality", limit=60)
    assert [(r["doc_id"], r["_text"]) for r in taken[0].collect()] == want
    plan = taken[0]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    classifier.fit(d, labels, "quality")  # fewer than the limit: all
    assert taken[1].count() == d.where("doc_id % 7 <> 0").count()
    with pytest.raises(ValueError):
        classifier.fit(d, labels.where("false"), "quality")


def test_sample_and_chunks(spark):
    d = spark.range(1000).select((F.col("id") * 7).alias("doc_id"))
    a = [r["doc_id"] for r in corpus.sample(d, 10, 1, "doc_id").collect()]
    assert a == [r["doc_id"] for r in corpus.sample(d.repartition(7), 10, 1, "doc_id").collect()] and len(set(a)) == 10
    rows = sorted(corpus.chunked(d, 4, "doc_id").collect())
    assert [r["pos"] for r in rows] == list(range(1000)) and all(r["chunk"] == r["pos"] // 4 for r in rows)
    assert corpus.chunked(d.where("false"), 4, "doc_id").count() == 0


def test_windows(spark):
    d = spark.createDataFrame([(1, list(range(10))), (2, [1, 2]), (3, [])], "doc_id long, ids array<int>")
    got = {(r["doc_id"], r["start"]): (r["x"], r["y"]) for r in corpus.training_windows(d, 4, 3).collect()}
    assert got == {(1, s): (list(range(s, s + 4)), list(range(s + 1, s + 5))) for s in (0, 3)}
    for r in corpus.random_windows(d, 4, 5, 3).collect():
        assert 0 <= r["start"] < 6 and r["x"] == list(range(r["start"], r["start"] + 4)) and r["y"][:-1] == r["x"][1:]
    r = d.orderBy("doc_id").select(corpus.last_tokens("ids", 3).alias("a"), corpus.until_sentinel("ids", 5).alias("b"), corpus.until_sentinel("ids", 0).alias("c")).collect()
    assert [tuple(x) for x in r] == [([7, 8, 9], [0, 1, 2, 3, 4], []), ([1, 2], [1, 2], [1, 2]), ([], [], [])]


def test_rate(spark):
    d = spark.createDataFrame([(0.0,), (50.0,), (100.0,), (450.0,), (800.0,), (900.0,)], "it double")
    got = [round(r["r"], 6) for r in d.select("it", corpus.cosine_rate(F.col("it"), 1.0, 0.1, 100, 800).alias("r")).orderBy("it").collect()]
    assert got == [0.0, 0.5, 1.0, 0.55, 0.1, 0.1]


def record(kind, body, extra=b""):
    return b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nContent-Length: " + str(len(body)).encode() + b"\r\n" + extra + b"\r\n" + body + b"\r\n\r\n"


def test_archives(spark, tmp_path):
    en = b"This is the page of the people that have been in the house and it was good for them."
    de = "Der Mann und die Frau sind mit dem Kind in einem Haus, das nicht auf der Karte ist.".encode()
    parts = [record(b"warcinfo", b"info"), record(b"conversion", en, b"X: y: z\r\n"), record(b"conversion", de), record(b"conversion", b"\xff\xfe the of and to in")]
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.warc.wet.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    (src / "b.warc.wet").write_bytes(parts[1] + b"WARC/1.0\r\nContent-Length: 99\r\n\r\ncut")
    r = warc.read_records(spark, str(src))
    rows = {(os.path.basename(x["file"]), x["pos"]): x for x in r.collect()}
    assert len(rows) == 5 and rows["a.warc.wet.gz", 1]["headers"]["X"] == "y: z" and bytes(rows["a.warc.wet.gz", 2]["payload"]) == de
    kept = warc.english_records(r)
    assert {(os.path.basename(x["file"]), x["pos"]) for x in kept.collect()} == {("a.warc.wet.gz", 0), ("a.warc.wet.gz", 1), ("a.warc.wet.gz", 3), ("b.warc.wet", 0)}
    out = warc.write_records(kept, str(tmp_path / "out"))
    assert {(os.path.basename(r["file"]), r["records"]) for r in out.collect()} == {("a.warc.wet.gz", 3), ("b.warc.wet.gz", 1)} and sorted(os.listdir(tmp_path / "out")) == ["a.warc.wet.gz", "b.warc.wet.gz"]
    assert gzip.decompress((tmp_path / "out" / "a.warc.wet.gz").read_bytes()) == parts[0] + parts[1] + parts[3]
    stats = {r["chunk"]: r["kept_percent"] for r in warc.filter_archives(spark, str(src), str(tmp_path / "again")).collect()}
    assert stats["b.warc.wet"] == 100.0 and 0 < stats["a.warc.wet.gz"] < 100 and sorted(os.listdir(tmp_path / "again")) == ["a.warc.wet.gz", "b.warc.wet.gz"]
    assert warc.read_records(spark, str(tmp_path / "again")).count() == 4
    twin = r.unionByName(r.withColumn("file", F.lit("/elsewhere/a.warc.wet.gz")))
    with pytest.raises(ValueError):
        warc.write_records(twin, str(tmp_path / "no"))


def test_responses(spark, tmp_path):
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(record(b"response", head + b"<p>\xe9 page</p>", b"WARC-Target-URI: http://e.org/\r\n") + record(b"request", b"GET /"))
    (r,) = warc.html_responses(warc.read_records(spark, str(tmp_path / "x.warc"))).collect()
    assert r["url"] == "http://e.org/" and bytes(r["html"]) == b"<p>\xe9 page</p>"


def test_kept_share(spark):
    d = spark.createDataFrame([(1, "abcd", True), (1, "é", False), (2, "", True)], "chunk int, text string, keep boolean")
    assert {r["chunk"]: (r["total_chars"], r["skipped_chars"], r["kept_percent"]) for r in warc.kept_share(d).collect()} == {1: (5, 1, 80.0), 2: (0, 0, 0.0)}


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, t in (("a.txt", "one\ntwo\n"), ("b.txt", "three")):
        (tmp_path / "d" / name).write_text(t)
    d = files.read_documents(spark, str(tmp_path / "d"))
    assert files.write_document_files(d, str(tmp_path / "e")) == 2
    assert (tmp_path / "e" / "a.txt").read_text() == "one\ntwo\n"
    (tmp_path / "l.csv").write_text("p/x.gz\np/y.gz\n")
    assert sorted(r[0] for r in files.read_listing(spark, str(tmp_path / "l.csv"), "base/").collect()) == ["base/p/x.gz", "base/p/y.gz"]
    page = spark.createDataFrame([("<a>w-2.bz2</a><a>w-1.bz2</a><a>w-2.bz2</a>",)], "value string")
    assert [r[0] for r in files.shard_names(page, "w-[0-9]+[.]bz2").collect()] == ["w-1.bz2", "w-2.bz2"]
    (tmp_path / "d2").mkdir()
    (tmp_path / "d2" / "a.txt").write_text("other")
    with pytest.raises(ValueError):
        files.write_document_files(files.read_documents(spark, [str(tmp_path / "d"), str(tmp_path / "d2")]), str(tmp_path / "f"))
    assert files.first_path(spark, str(tmp_path / "l.csv"), "base/") == "base/p/x.gz"
    assert tuple(files.file_sizes(spark, str(tmp_path / "d")).first()) == (2, 13)
    dump = "a &lt;ref&gt;{{cite|url=http://a.org/x?y=1&amp;z}} &lt;/ref&gt; b\nno http://b.org\n".encode() + b"&lt;ref&gt;http://c.org/\xff. &lt;/ref&gt;\n"
    (tmp_path / "w.bz2").write_bytes(bz2.compress(dump))
    assert sorted(r[0] for r in files.dump_urls(spark, str(tmp_path / "w.bz2")).collect()) == ["http://a.org/x?y=1+z", "http://c.org/"]
    built = []
    for _ in range(2):
        assert memoised(spark, str(tmp_path / "memo"), lambda: built.append(1) or spark.range(3)).count() == 3
    assert built == [1]
    files.write_gzip_lines(spark.createDataFrame([("u",)], "value string"), str(tmp_path / "g"))
    assert glob.glob(str(tmp_path / "g" / "*.gz"))


def test_tokens(spark, tmp_path):
    t = spark.createDataFrame([(i, [i, 65535, 0]) for i in range(50)], "doc_id long, ids array<int>")
    out = files.write_tokens(t, str(tmp_path / "t"), parts=3).collect()
    assert sum(r["tokens"] for r in out) == 150
    flat = b"".join((tmp_path / "t" / f).read_bytes() for f in sorted(os.listdir(tmp_path / "t")))
    (tmp_path / "t.bin").write_bytes(flat)
    got = files.read_token_files(spark, str(tmp_path / "t.bin"), piece=7).orderBy("pos").collect()
    assert sum((r["tokens"] for r in got), []) == [x for i in range(50) for x in (i, 65535, 0)]


def test_trained_classifier(spark):
    rows = [(i, "good clear prose about rivers %d" % i if i % 3 else "buy cheap pills click now %d" % i, int(i % 3 > 0)) for i in range(60)]
    d = spark.createDataFrame([(a, b) for a, b, _ in rows] + [(99, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows], "doc_id long, quality int")
    m = classifier.fit(d, labels, "quality")
    got = {r["doc_id"]: r["pred"] for r in classifier.classify(m, d, "cc", "wiki").collect()}
    assert all(got[a]["label"] == ("wiki" if c else "cc") and got[a]["score"] > 0.5 for a, _, c in rows) and 99 in got
    with pytest.raises(ValueError):
        classifier.fit(d, labels.where("quality = 1"), "quality")


def test_trained_classifier_after_an_observation(spark):
    assert durable_counted(spark.range(3))[1] == 3
    d = docs(spark, *["good prose" if i % 2 else "cheap pills" for i in range(20)])
    labels = d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    m = classifier.fit(d, labels, "toxic")
    assert [r["label"] for r in classifier.classify(m, d, "no", "yes").orderBy("doc_id").select("pred.label").collect()] == ["no", "yes"] * 10


def test_stream(spark, tmp_path):
    docs(spark, "word " * 60 + "a@b.org", "short").write.parquet(str(tmp_path / "in"))
    s = events.clean_stream(spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert [r["doc_id"] for r in spark.table("cleaned").collect()] == [0]


def test_path_level_calls(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for name, text in {"a.txt": "shared\n", "b.txt": "shared\n", "c.txt": "own line\nshared\n", "d.txt": LICENCE, "e.txt": LICENCE.replace("free of charge", "without charge")}.items():
        (src / name).write_text(text)
    paths = [src / n for n in sorted(os.listdir(src))]
    assert api.exact_line_deduplication(spark, paths[:3], tmp_path / "lines") == 3
    assert {f: (tmp_path / "lines" / f).read_text() for f in os.listdir(tmp_path / "lines")} == {"a.txt": "", "b.txt": "", "c.txt": "own line\n"}
    assert api.minhash_deduplication(spark, paths, 100, 25, 5, 0.8, tmp_path / "near") == 3
    assert sorted(os.listdir(tmp_path / "near")) == ["a.txt", "c.txt", "d.txt"] and (tmp_path / "near" / "d.txt").read_text() == LICENCE


def test_text_level_calls(spark):
    assert api.classify_nsfw(spark, "S*CK MY D*CK YOU F*CKING *SSH*LES, JUST LET ME EDIT THE PAGE AND BE GONE")[0] == "nsfw"
    assert api.classify_nsfw(spark, "There is no article on the ** history ** of that trade, it seems.")[0] == "non-nsfw"
    assert api.classify_toxic(spark, "That moron again! Is this idiot not able to read? What a twat, and all you fuckers let it pass.")[0] == "toxic"
    label, score = api.classify_toxic(spark, "Why the fc*k am I warned when I did nothing at all?")
    assert label == "non-toxic" and score > 0
    assert api.identify_language(spark, "This is the house that they have in the town.")[0] == "en"
    assert api.mask_emails(spark, "to a@b.org")[1] == 1 and api.mask_ips(spark, "192.0.2.1.") == ("|||IP_ADDRESS|||.", 1) and api.mask_phones(spark, "call 212-555-0123")[1] == 1
    assert not api.passes_quality_rules(spark, "too short") and api.extract_text(b"<p>one</p><p>two</p>") == "one\n\ntwo"
