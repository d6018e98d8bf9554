"""Quality rules: word and line statistics, and perplexity bands of a modified Kneser-Ney character model.

The model is counted by Spark over every whole text: a character is a 16-bit symbol, 0 is the padding, and an n-gram of up
to four of them is a packed 64-bit key. Symbols 1 to 63 are the letters of French, German, Spanish and English, digits,
blanks and ASCII marks; every other character from U+00C0 on is its own lower-cased code point (those above U+FFFF are hashed
to the surrogate and private areas). A table grows with the different n-grams of its language; counts are summed in each task before
the shuffle. Scores leave the document out: an n-gram that no other text has backs off. The model of a language is a set of sorted key arrays, one per order, with
log probabilities and back-off weights, searched by bisection. A document's score is its mean negative log2
probability per character; a language's band reaches from the lower to the upper outer fence of its documents' scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.session import durable

ORDER, BITS = 4, 6
#: A symbol's bits above the lowest ``BITS``: those of an n-gram lie above ``LOW`` in its key, so keys of classes are 24-bit keys.
HIGH, LOW = 16 - BITS, ORDER * BITS
SYMBOLS = b"#*$%&|<>"
#: Languages with models of their own; all other values of ``lang`` share one, which bounds the number of models.
LANGUAGES = "af ar az be bg bn bs ca cs cy da de el en eo es et eu fa fi fr ga gl he hi hr hu hy id is it ja ka kk ko lt lv mk ms mt nb nl no pl pt ro ru sk sl sq sr sv sw ta te th tr uk ur uz vi zh".split()
OTHER = "other"


def _classes() -> np.ndarray:
    table = np.full(0x10000, 63, np.uint32)
    kinds = ["aA", "bB", "cC", "dD", "eE", "fF", "gG", "hH", "iI", "jJ", "kK", "lL", "mM", "nN", "oO", "pP", "qQ", "rR", "sS", "tT", "uU", "vV", "wW", "xX", "yY", "zZ"]
    kinds += ["àÀ", "âÂ", "äÄ", "áÁ", "ãÃåÅ", "æÆ", "çÇ", "éÉ", "èÈ", "êÊ", "ëË", "îÎïÏ", "íÍìÌ", "ñÑ", "ôÔõÕ", "öÖøØ", "óÓòÒ", "œŒ", "ùÙûÛ", "üÜ", "úÚ", "ß"]
    kinds += [" \t\r\x0b\x0c\xa0", "\n", "0123456789", ".", ",", ";:", "!?", "'\"`«»", "()[]{}", "-–_/\\", "#*", "$%", "&|", "<>"]
    for i, chars in enumerate(kinds, 1):
        for c in chars:
            table[ord(c)] = i
    assert len(kinds) < 63
    listed = {ord(c) for chars in kinds for c in chars}
    for cp in range(0xC0, len(table)):
        if cp not in listed:
            low = chr(cp).lower()
            to = ord(low) if len(low) == 1 else cp
            table[cp] = table[to] if to in listed else to
    return table


_CLASS = _classes()


def classes_of(text: str) -> np.ndarray:
    """The symbol of every character, with ``ORDER - 1`` paddings in front."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(cp) and cp.max() > 0xFFFF:
        cp = np.where(cp > 0xFFFF, 0xD800 + (cp * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(0xF900 - 0xD800), cp)
    out = np.zeros(len(cp) + ORDER - 1, np.uint32)
    out[ORDER - 1 :] = _CLASS[cp]
    return out


def grams(s: np.ndarray) -> np.ndarray:
    """Packed keys of all ORDER-grams of a padded text: one per character."""
    low, high = s & np.uint32((1 << BITS) - 1), s >> np.uint32(BITS)
    n = len(s) - ORDER + 1
    key = low[:n].copy()
    for i in range(1, ORDER):
        key = (key << np.uint32(BITS)) | low[i : n + i]
    key = key.astype(np.uint64)
    if high.any():
        top = high[:n].astype(np.uint64)
        for i in range(1, ORDER):
            top = (top << np.uint64(HIGH)) | high[i : n + i]
        key |= top << np.uint64(LOW)
    return key


def context(key: np.ndarray) -> np.ndarray:
    """The keys without their last symbol."""
    return (key >> np.uint64(LOW + HIGH) << np.uint64(LOW)) | ((key & np.uint64((1 << LOW) - 1)) >> np.uint64(BITS))


def tail(key: np.ndarray, n: int) -> np.ndarray:
    """The keys of ``n`` symbols without their first one."""
    return key & np.uint64(((1 << HIGH * (n - 1)) - 1) << LOW | ((1 << BITS * (n - 1)) - 1))


def count_grams(docs: DataFrame) -> DataFrame:
    """``(lang, key, n)`` over all documents; a task sums its counts before they are shuffled. ``docs``: (lang, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def merge(lang: str) -> None:
            keys, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
            size[lang] = 0
            if lang in sums:
                old, m = sums[lang]
                both, at = np.unique(np.concatenate([old, keys]), return_inverse=True)
                keys, n = both, np.bincount(at, np.concatenate([m, n])).astype(np.int64)
            sums[lang] = keys, n

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            keys, n = sums.pop(lang)
            for i in range(0, len(keys), 1 << 16):
                k = keys[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(n[i : i + (1 << 16)])], ["lang", "key", "n"])

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                s = text.as_py()
                if s:
                    held.setdefault(lang, []).append(g := grams(classes_of(s)))
                    size[lang] = size.get(lang, 0) + len(g)
                    if size[lang] > 1 << 22:
                        merge(lang)
                        if len(sums[lang][0]) > 1 << 22:  # bounded memory; the shuffle sums the parts
                            yield from flush(lang)
        for lang in list(held):
            merge(lang)
        for lang in list(sums):
            yield from flush(lang)

    return docs.mapInArrow(work, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))


class Model:
    """Modified Kneser-Ney over packed keys: for each order a sorted key array, log2 probabilities, back-off weights."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        at = np.argsort(keys)
        level = [(keys[at].astype(np.uint64), counts[at].astype(np.float64))]
        for n in range(ORDER - 1, 0, -1):  # continuation counts: how many different characters come before
            tails, c = np.unique(tail(level[0][0], n + 1), return_counts=True)
            level.insert(0, (tails, c.astype(np.float64)))
        self.counts = [np.minimum(c, (1 << 32) - 1).astype(np.uint32) for _, c in level]
        self.keys, self.logp, self.ctx, self.logb = [], [], [], []
        self.symbols = max(1 << BITS, len(level[0][0]) + 1)  # the uniform distribution at the end is over the symbols seen, and one for the rest
        lower = None
        for n, (k, c) in enumerate(level, 1):
            of = [float((c == i).sum()) for i in (1, 2, 3, 4)]
            y = of[0] / (of[0] + 2 * of[1]) if of[0] else 0.0
            cut = np.array([0.0] + [min(max((i + 1) - (i + 2) * y * of[i + 1] / of[i], 0.05), i + 0.95) if of[i] else 0.5 for i in range(3)])
            d = cut[np.minimum(c, 3).astype(int)]
            ctx, at = np.unique(context(k), return_inverse=True)
            total = np.bincount(at, c)
            spare = np.bincount(at, d) / total
            below = np.full(len(k), 1.0 / self.symbols) if lower is None else lower[np.searchsorted(level[n - 2][0], tail(k, n))]
            lower = (c - d) / total[at] + spare[at] * below
            self.keys.append(k)
            self.logp.append(np.log2(lower).astype(np.float32))
            self.ctx.append(ctx)
            self.logb.append(np.log2(spare).astype(np.float32))

    def score(self, key: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """log2 probability of the last character of each ORDER-gram; unseen ones, back off.

        With ``own``, how often a document holds each of its distinct keys, n-grams that only this document has back off too;
        at the lower orders those are the ones whose every continuation is the document's alone.
        """
        out = np.zeros(len(key), np.float32)
        open_, k, back = np.arange(len(key)), key, np.zeros(len(key), np.float32)
        for n in range(ORDER, 0, -1):
            at = np.minimum(np.searchsorted(self.keys[n - 1], k), len(self.keys[n - 1]) - 1)
            hit = self.keys[n - 1][at] == k
            if own is not None:
                hit &= self.counts[n - 1][at] > own
            out[open_[hit]] = back[hit] + self.logp[n - 1][at[hit]]
            if hit.all():
                return out
            open_, k, back = open_[~hit], k[~hit], back[~hit]
            c = context(k)
            at = np.minimum(np.searchsorted(self.ctx[n - 1], c), len(self.ctx[n - 1]) - 1)
            back = back + np.where(self.ctx[n - 1][at] == c, self.logb[n - 1][at], 0)
            k = tail(k, n)
            if own is not None:
                _, at, own = np.unique(k, return_inverse=True, return_counts=True)
                own = own[at]
        out[open_] = back - np.float32(np.log2(self.symbols))
        return out

    def dump(self) -> bytes:
        sink = pa.BufferOutputStream()
        cols = {f"{what}{n}": pa.array([getattr(self, what)[n]]) for what in ("keys", "counts", "logp", "ctx", "logb") for n in range(ORDER)}
        cols["symbols"] = pa.array([[self.symbols]])
        t = pa.table(cols)
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(t)
        return sink.getvalue().to_pybytes()

    @classmethod
    def load(cls, data: bytes) -> Model:
        t = pa.ipc.open_stream(data).read_all()
        m = cls.__new__(cls)
        for what in ("keys", "counts", "logp", "ctx", "logb"):
            setattr(m, what, [t[f"{what}{n}"].chunk(0).values.to_numpy() for n in range(ORDER)])
        m.symbols = t["symbols"][0].as_py()[0]
        return m


#: Bytes of all models, packed, up to which they are broadcast; beyond, texts are dealt to their language's model.
MODEL_BYTES = 192 << 20
#: Characters of texts that are dealt to one copy of a model then.
DEAL_CHARS = 256 << 20


def fit(docs: DataFrame) -> DataFrame:
    """``(lang, model, size, chars)``, written: one model per language from all texts of ``docs`` (lang, text), each built in one task; at most ``len(LANGUAGES) + 1`` rows."""

    def build(key: tuple[str], t: pa.Table) -> pa.Table:
        n = t["n"].to_numpy()
        m = Model(t["key"].to_numpy().view(np.uint64), n).dump()
        return pa.table({"lang": pa.array([key[0].as_py()]), "model": pa.array([m], pa.binary()), "size": pa.array([len(m)], pa.int64()), "chars": pa.array([int(n.sum())], pa.int64())})

    return durable(count_grams(docs).groupBy("lang").applyInArrow(build, "lang string, model binary, size bigint, chars bigint"), "models")


def _words_hash(cache: dict[bytes, int], words: list[bytes]) -> np.ndarray:
    if len(cache) > 1_000_000:
        cache.clear()
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v


def repeat_words(h: np.ndarray, width: int = 8) -> int:
    """Words inside ``width``-word windows that occur twice or more in the text; the first occurrence counts too."""
    n = len(h) - width + 1
    if n < 2:
        return 0
    w, span = h, 1
    while span < width:  # width is a power of two: windows double
        w = w[: len(w) - span] * np.uint64(0x9E3779B97F4A7C15) + (w[span:] ^ (w[span:] >> np.uint64(29)))
        w ^= w >> np.uint64(32)
        span *= 2
    s = np.sort(w)
    if not (s[1:] == s[:-1]).any():
        return 0
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    mark = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + width, -1)
    return int((np.cumsum(mark[:-1]) > 0).sum())


_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")


def base_stats(text: str, cache: dict[bytes, int]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    symbols = sum(map(raw.count, SYMBOLS))
    lines = text.split("\n")
    dup = 0
    if len(lines) > 1:
        seen: set[str] = set()
        for line in lines:
            if line in seen:
                dup += 1
            elif _HAS_WORD.search(line):
                seen.add(line)
    return len(words), chars, symbols, dup, repeat_words(_words_hash(cache, words))


def _with_lang(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    lang = F.lower(F.col(lang_col)) if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.when(lang.isin(LANGUAGES), lang).otherwise(OTHER).alias("lang"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", fence: float = 4.0, least_width: float = 0.6, spread: float = 9.0) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lang, score, low, high)``.

    ``base_failed``: fewer than 20 words, or over 30 % of the words in repeated 8-word windows. ``kept``: not failed, and
    the score inside the language's band. The band is [q1 - w, q3 + w], w = ``fence`` times the distance of the quartiles,
    at least ``least_width`` bits, plus ``spread`` over the root of the document's characters, since short texts scatter more;
    quartiles are exact to 1/1000 bit, over the documents of the language that passed the base rules.

    Null texts are empty texts: zero words, failed. Whitespace-only texts likewise. Null or unknown languages share the
    model ``other``. Repeated rows give repeated results. An empty table gives an empty result. Extra columns are ignored.
    """
    spark = docs.sparkSession
    slim = _with_lang(docs, id_col, text_col, lang_col)
    models = fit(slim.select("lang", "text"))
    size = models.agg(F.sum("size").alias("s")).first()["s"] or 0
    near = spark.sparkContext.broadcast({r["lang"]: bytes(r["model"]) for r in models.select("lang", "model").collect()} if size <= MODEL_BYTES else None)
    kind = dict(slim.dtypes)["doc_id"]
    if size > MODEL_BYTES:
        # each copy of a model comes first in its part, the texts that are dealt to it stream behind; a hot language has many copies
        copies = models.select("lang", "model", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("chars") / DEAL_CHARS))).alias("part"))
        dealt = slim.join(F.broadcast(models.select("lang", F.floor(F.col("chars") / DEAL_CHARS).alias("last"))), "lang", "left")  # one row a language
        dealt = dealt.select("doc_id", "text", "lang", F.pmod(F.xxhash64("doc_id", "text"), F.coalesce("last", F.lit(0)) + 1).alias("part"), F.lit(None).cast("binary").alias("model"))
        heads = copies.select(F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "part", "model")
        order = ["lang", "part", F.col("model").isNull()]
        slim = heads.unionByName(dealt).repartition("lang", "part").sortWithinPartitions(*order)
    else:
        slim = slim.withColumn("model", F.lit(None).cast("binary"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, Model] = {}
        cache = _Hashes()
        for b in batches:
            rows, docs = [], []
            for i, (lang, text, model) in enumerate(zip(b.column("lang").to_pylist(), b.column("text"), b.column("model"), strict=True)):
                if model.is_valid:
                    loaded = {lang: Model.load(model.as_py())}
                    continue
                docs.append(i)
                s = text.as_py()
                score = 0.0
                if s:
                    if lang not in loaded:
                        loaded[lang] = Model.load(near.value[lang])
                    keys, n = np.unique(grams(classes_of(s)), return_counts=True)
                    score = -float((loaded[lang].score(keys, n) * n).sum()) / len(s)
                rows.append((*base_stats(s, cache), len(s), score))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            at = pa.array(docs, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("lang").take(at), *[pa.array(c, pa.int64()) for c in cols[:6]], pa.array(cols[6], pa.float64())], ["doc_id", "lang", *NAMES, "n_chars", "score"])

    scored = slim.mapInArrow(work, f"doc_id {kind}, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_chars bigint, score double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = durable(scored.withColumn("base_failed", failed), "scored")
    bands = _bands(spark, scored, fence, least_width)
    more = F.lit(spread) / F.sqrt(F.greatest("n_chars", F.lit(1)))
    low, high = F.col("low") - more, F.col("high") + more
    inside = F.col("score").between(low, high)
    return scored.join(F.broadcast(bands), "lang", "left").select(  # one row a language: at most len(LANGUAGES) + 1
        "doc_id", *NAMES, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"), "lang", "score", low.alias("low"), high.alias("high")
    )


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _bands(spark: SparkSession, scored: DataFrame, fence: float, least: float) -> DataFrame:
    """Quartiles by a histogram in steps of 1/1000 bit: at most 64000 partly aggregated rows a language."""
    hist = scored.where("not base_failed").groupBy("lang", F.floor(F.col("score") * 1000).cast("int").alias("b")).agg(F.count("*").alias("n"))
    by: dict[str, list[tuple[int, int]]] = {}
    for r in hist.collect():
        by.setdefault(r["lang"], []).append((r["b"], r["n"]))
    rows = []
    for lang, bins in by.items():
        bins.sort()
        b, n = np.array(bins).T
        upto = np.cumsum(n)
        q1, q3 = (float(b[np.searchsorted(upto, q * upto[-1])]) / 1000 for q in (0.25, 0.75))
        w = max(fence * (q3 - q1), least)
        rows.append((lang, q1 - w, q3 + w))
    return spark.createDataFrame(rows, "lang string, low double, high double")
