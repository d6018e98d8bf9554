"""Row-local operators: masks, quality rules, languages, markup, URLs."""

import random

import pytest
from pyspark.sql import functions as F

from siftlake.functions import gopher, langid, markup, pii, urls
from siftlake.functions.words import decoded, decoded_ignoring, lines, word_ngrams, words
from siftlake.models import classifier


def apply(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r["out"] for r in df.select("i", f(F.col("text")).alias("out")).orderBy("i").collect()]


def test_emails(spark):
    a, b, c, d = apply(spark, pii.mask_emails, "Write to ann.lee+x@mail.example.org.", "a@b.co and c_d@e-f.net!", "old |||EMAIL_ADDRESS||| and new z@y.com", None)
    assert tuple(a) == ("Write to |||EMAIL_ADDRESS|||.", 1)
    assert b["n"] == 2 and c["n"] == 1 and c["text"].count("|||EMAIL_ADDRESS|||") == 2
    assert d["text"] is None


@pytest.mark.parametrize("number", ["4155550123", "(415)-555-0123", "(415) 555 0123", "415-555-0123", "+1 415 555 0123"])
def test_phones(spark, number):
    (r,) = apply(spark, pii.mask_phones, f"Call {number} today.")
    assert tuple(r) == ("Call |||PHONE_NUMBER||| today.", 1)


def test_long_digit_runs_are_no_phones(spark):
    assert apply(spark, pii.mask_phones, "card 4111111111111111 id ab4155550123")[0]["n"] == 0


def test_ips(spark):
    (r,) = apply(spark, pii.mask_ips, "Hosts 192.0.2.146 and 10.0.0.255. Not 300.1.1.1x")
    assert r["text"].startswith("Hosts |||IP_ADDRESS||| and |||IP_ADDRESS|||. ")


def test_masks_are_idempotent(spark):
    text = "m@x.org, 198.51.100.7 and 212-555-0199"
    (once,) = apply(spark, pii.mask_all, text)
    assert apply(spark, pii.mask_all, once) == [once]


def keep(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r["keep"] for r in gopher.with_metrics(df).orderBy("i").collect()]


def test_gopher_bounds(spark):
    few, least, many, most = "word " * 49, "word " * 50, "word " * 100_001, "word " * 100_000
    assert keep(spark, few, least, many, most) == [False, True, False, True]
    assert keep(spark, "ab " * 100, "abc " * 100, "a" * 10 + " " + ("b" * 10 + " ") * 99, ("c" * 11 + " ") * 100) == [False, True, True, False]
    line = "some words that make up one line here"
    dots = lambda n: "\n".join([line + "..."] * n + [line] * (10 - n))
    assert keep(spark, dots(3), dots(4), dots(4).replace("...", "…")) == [True, False, False]
    assert keep(spark, "word " * 80 + "1234 " * 20, "word " * 79 + "1234 " * 21) == [True, False]
    assert keep(spark, None, "", " \n ") == [False, False, False]


def test_languages(spark):
    en, zh, fr, none, null = apply(spark, langid.identify, "This is the story of a whale and of the man that hunted it.", "我们今天去公园散步", "La maison est dans la rue avec les enfants", "12345 !!", None)
    assert (en["label"], zh["label"], fr["label"], none["label"], null) == ("en", "zh", "fr", "und", None)
    assert all(0 < x["score"] <= 1 for x in (en, zh, fr, none)) and en["score"] >= 0.7


PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"/><title>no</title><style>p{}</style></head><body>
<div><h1>Big Title</h1><div><p>
  One  paragraph over
  two lines &amp; more.
</p><img src="x.jpg" title="no"/><p>With a <a href="l">link</a>.</p></div>
<ul><li>First</li><li>Second</li></ul><script>var a = "<p>no</p>";</script></div></body></html>"""


def test_layout():
    want = "Big Title\n\nOne paragraph over two lines & more.\n\nWith a link.\n\n  • First\n  • Second"
    assert markup.layout_text(PAGE.encode()) == want == markup.layout_text(PAGE)
    assert markup.layout_text(None) is None and markup.layout_text(b"") == ""
    assert markup.layout_text("<meta charset=latin-1><p>caf\xe9</p>".encode("latin-1")) == "caf\xe9"
    assert markup.layout_text(b"<p>a\xffb</p>") == "a�b"


def test_strip_tags(spark):
    assert apply(spark, markup.strip_tags, PAGE, None, "")[0] == "Big Title One paragraph over two lines & more. With a link . First Second"


def test_urls(spark):
    line = "x &lt;ref&gt;see http://a.example/p?q=1. and ftp://b.example/f- end&lt;/ref&gt; y http://out.example"
    (r,) = apply(spark, lambda c: urls.urls_in(urls.reference_part(c)), line)
    assert r == ["http://a.example/p?q=1", "ftp://b.example/f"]
    assert apply(spark, urls.reference_part, "no tag") == [None]


def test_words_and_lines(spark):
    assert apply(spark, words, " a\tb\n\nc ", "", None) == [["a", "b", "c"], [], None]
    assert apply(spark, lines, "a\nb\n", "a\n\n", "a") == [["a", "b"], ["a", ""], ["a"]]
    assert apply(spark, lambda c: word_ngrams(words(c), 2), "a b c", "a", "") == [["a b", "b c"], ["a"], []]


def test_decoding(spark):
    df = spark.createDataFrame([(bytearray(b"ok\xffend"),)], "b binary")
    r = df.select(decoded(F.col("b")).alias("x"), decoded_ignoring(F.col("b")).alias("y")).first()
    assert tuple(r) == ("ok�end", "okend")


def test_lexicons(spark):
    bad, good = apply(spark, classifier.classify_nsfw, "free porn xxx here", "a walk in the park with friends")
    assert (bad["label"], good["label"]) == ("nsfw", "non-nsfw") and bad["score"] > 0 and good["score"] > 0
    bad, good = apply(spark, classifier.classify_toxic_words, "you stupid idiot", "thanks for the kind note")
    assert (bad["label"], good["label"]) == ("toxic", "non-toxic")


def test_phones_are_searched_once(spark):
    parts = ["555", "5550123", "0123", "212", "(212)", "+1", "+", " ", ".", "-", "1", "a", "\n", "\u00e9", "\U0001f600", "(", ")", "|||PHONE_NUMBER|||", "$1", "212-555-0123", "(212) 555-0123"]
    draw = random.Random(3)
    d = spark.createDataFrame([("".join(draw.choices(parts, k=draw.randrange(14))),) for _ in range(5000)] + [(None,), ("",)], "text string")
    got = d.select(pii._masked(F.col("text"), pii.PHONE, "$1" + pii.PHONE_TOKEN).alias("a"), pii.mask_phones(F.col("text")).alias("b"))
    rows = got.collect()
    assert all(r["a"] == r["b"] for r in rows) and sum(r["b"]["n"] or 0 for r in rows) > 1000
    plan = d.select(pii.mask_phones(F.col("text")).alias("m"))._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and plan.count("RegExp") == 0
