"""Queries over the driver's tables, one per operator, with the SQL that a second engine can check them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions import gopher, langid, markup, pii, urls
from siftlake.functions.words import held, word_ngrams, words
from siftlake.models import classifier
from siftlake.operators import corpus, dedup
from siftlake.session import durable, table
from siftlake.sources.warc import kept_share
from siftlake.streaming import events as streaming

P = dedup.MinHash(num_hashes=100, num_bands=25, ngrams=5, jaccard_threshold=0.8)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict, masks and language of the documents that pass."""
    kept = gopher.with_metrics(_docs(spark, sf_dir)).where("keep")
    return kept.select("doc_id", "n_words", "mean_word_length", pii.mask_all(F.col("text")).alias("text"), langid.identify(F.col("text")).alias("language"))


def gopher_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = gopher.with_metrics(_docs(spark, sf_dir))
    r = lambda c: F.round(c, 6).alias(c)
    return m.select("doc_id", "n_words", r("mean_word_length"), r("ellipsis_share"), r("alpha_share"), "stop_words", r("symbol_ratio"), r("bullet_share"), "keep")


def gopher_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gopher.with_metrics(_docs(spark, sf_dir)).where("keep").select("doc_id", "text")


def _mask(f: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _docs(spark, sf_dir).select("doc_id", f(F.col("text")).alias("m")).select("doc_id", "m.text", F.col("m.n").cast("long").alias("n"))

    return run


def mask_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", pii.mask_all(F.col("text")).alias("text"))


def line_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.line_counts(_docs(spark, sf_dir))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_line_dedup(_docs(spark, sf_dir))


def exact_doc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_document_dedup(_docs(spark, sf_dir)).select("doc_id", "text")


def word_ngrams_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _docs(spark, sf_dir).select("doc_id", words(F.lower("text")).alias("w"))
    g = w.select("doc_id", word_ngrams(F.col("w"), 5).alias("g"))
    return g.select("doc_id", F.size("g").cast("long").alias("n"), F.size(F.array_distinct("g")).cast("long").alias("n_distinct"))


def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portable signatures: the least MD5 of seed and shingle, four seeds. A row is one text until its minima are found; rows of one id are merged after that."""
    w = _docs(spark, sf_dir).select("doc_id", words(F.lower("text")).alias("w"))
    g = held(w, "g", word_ngrams(F.col("w"), 5)).where(F.size("g") > 0)
    least = lambda i: F.array_min(F.transform("g", lambda s: F.md5(F.concat(F.lit(f"{i}|"), s))))
    own = g.select("doc_id", *[least(i).alias(f"h{i}") for i in range(4)])
    return own.groupBy("doc_id").agg(*[F.min(f"h{i}").alias(f"h{i}") for i in range(4)])


def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified pairs between the representatives of equal shingle sets."""
    return dedup.near_duplicate_pairs(_docs(spark, sf_dir), P).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def near_dup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicate_clusters(_docs(spark, sf_dir), P)


def minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.minhash_dedup(_docs(spark, sf_dir), P).select("doc_id", "text")


def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the LSH buckets are: bands and the documents in them, without spelling out pairs."""
    b = dedup.band_keys(dedup.sketches(_docs(spark, sf_dir), P))
    return b.groupBy("band").agg(F.count("*").alias("docs")).groupBy("docs").agg(F.count("*").alias("buckets"))


def langid_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held(_docs(spark, sf_dir).select("doc_id", "text"), "p", langid.identify(F.col("text"))).select("doc_id", "p.label", F.round("p.score", 6).alias("score"))


def english_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = held(_docs(spark, sf_dir).select("doc_id", "text"), "p", langid.identify(F.col("text")))
    return p.where("p.label = 'en' and p.score >= 0.7").select("doc_id", "text")


def filter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code points in all and skipped, and the percentage kept, per chunk of documents (here: per source)."""
    p = held(_docs(spark, sf_dir).select("source", "text"), "p", langid.identify(F.col("text")))
    d = p.select(F.col("source").alias("chunk"), "text", F.expr("p.label = 'en' and p.score >= 0.7").alias("keep"))
    return kept_share(d).withColumn("kept_percent", F.round("kept_percent", 6))


def sample_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.sample(_docs(spark, sf_dir).select("doc_id", "source"), 100, 336, "doc_id")


def chunk_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.chunked(_docs(spark, sf_dir).select("doc_id"), 4, "doc_id")


def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded link names for pages in the order of their ids."""
    p = table(spark, sf_dir, "pages").select("page_id", F.element_at(F.split("url", "/"), -1).alias("base"))
    return corpus.padded_names(p, "base", "page_id").select("page_id", "link")


def extract_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URLs of all pages as reference lines of a dump, kept with duplicates."""
    line = F.concat(F.lit("x &lt;ref&gt"), "url", F.lit(" see.&lt;/ref&gt; y"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(urls.urls_in(urls.reference_part(line))).alias("url"))


def document_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.explode(urls.urls_in(F.col("text"))).alias("url"))


def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1))
    return table(spark, sf_dir, "pages").select(host.alias("host")).groupBy("host").agg(F.count("*").alias("n"))


def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("source").distinct()


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", markup.strip_tags(F.col("html")).alias("text"))


def html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", markup.layout_text_udf("html").alias("text"))


def _trained(label: str, negative: str, positive: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        model = classifier.fit(_docs(spark, sf_dir), table(spark, sf_dir, "labels"), label)
        return classifier.classify(model, _docs(spark, sf_dir).select("doc_id", "text"), negative, positive).select("doc_id", "pred.label", "pred.score")

    return run


def classify_nsfw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", classifier.classify_nsfw(F.col("text")).alias("p")).select("doc_id", "p.label", F.round("p.score", 6).alias("score"))


def classify_toxic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", classifier.classify_toxic_words(F.col("text")).alias("p")).select("doc_id", "p.label", F.round("p.score", 6).alias("score"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lengths stand for token ids: training windows do not care which tokenizer made them."""
    return _docs(spark, sf_dir).select("doc_id", F.transform(words(F.col("text")), lambda w: F.length(w)).alias("ids"))


def pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = corpus.training_windows(_tokens(spark, sf_dir), 32, 32)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return w.select("doc_id", F.col("start").cast("long").alias("start"), F.size("x").cast("long").alias("n"), total("x").alias("sum_x"), total("y").alias("sum_y"))


def random_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = corpus.random_windows(_tokens(spark, sf_dir), 32, 2, 336)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return w.select("doc_id", F.col("draw").cast("long").alias("draw"), F.col("start").cast("long").alias("start"), F.size("x").cast("long").alias("n"), total("x").alias("sum_x"), total("y").alias("sum_y"))


def context_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokens(spark, sf_dir)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return t.select("doc_id", F.size(last := corpus.last_tokens("ids", 16)).cast("long").alias("n"), total(last).alias("sum_last"), F.size(corpus.until_sentinel("ids", 12)).cast("long").alias("n_before"))


def top_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three longest documents of each source."""
    return corpus.top_k(_docs(spark, sf_dir).select("doc_id", "source", "n_chars"), ["source"], "n_chars", 3, "doc_id").select("source", "doc_id", "n_chars", F.col("rank").cast("long").alias("rank"))


def cosine_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = F.col("doc_id").cast("double")
    return _docs(spark, sf_dir).select("doc_id", F.round(corpus.cosine_rate(it, 1.0, 0.1, 100, 800), 6).alias("rate"))


def mean_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label join and unweighted means."""
    j = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    return j.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.sum("n_chars").alias("sum_chars"))


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels but without toxicity, minus those of the first source, and the bag union with the benchmark."""
    labelled = table(spark, sf_dir, "labels").where("toxic = 0").select(F.col("doc_id").alias("id"))
    first = _docs(spark, sf_dir).where("source = 'src0'").select(F.col("doc_id").alias("id"))
    return labelled.intersect(_docs(spark, sf_dir).select(F.col("doc_id").alias("id"))).exceptAll(first).unionByName(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = streaming.windowed_counts(table(spark, sf_dir, "events"))
    return e.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def cleaning_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language filter, quality rules, masks, line dedup, document dedup."""
    english = held(_docs(spark, sf_dir).select("doc_id", "text"), "p", langid.identify(F.col("text"))).where("p.label = 'en' and p.score >= 0.7").drop("p")
    kept = durable(gopher.with_metrics(english).where("keep").select("doc_id", pii.mask_all(F.col("text")).alias("text")), "kept")
    lines = durable(dedup.exact_line_dedup(kept).where("text <> ''"), "lines")
    return dedup.exact_document_dedup(lines).select("doc_id", "text")


def toxic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not toxic with a score of 0.95 or more."""
    p = held(_docs(spark, sf_dir).select("doc_id", "text"), "p", classifier.classify_toxic_words(F.col("text")))
    return p.where("p.label = 'non-toxic' and p.score >= 0.95").select("doc_id", "text")


def source_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and code points by language and source, with totals."""
    d = _docs(spark, sf_dir).rollup("lang", "source").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return d.select("lang", "source", "level", "n", "chars")


def label_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").cube("quality", "toxic").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))
    return d.select("quality", "toxic", "level", "n")


def length_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quartiles of the lengths by language, from counts per length."""
    q = F.percentile("n_chars", F.lit([0.25, 0.5, 0.75]))
    return _docs(spark, sf_dir).groupBy("lang").agg(q.alias("q")).select("lang", *[F.round(F.col("q")[i], 6).alias(f"q{i + 1}") for i in range(3)])


def approx_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources, and how far the sketched number of distinct texts is from the exact one: within a twentieth."""
    d = _docs(spark, sf_dir).agg(F.approx_count_distinct("source", 0.01).alias("sources"), F.approx_count_distinct("text", 0.01).alias("a"), F.count_distinct(F.xxhash64("text")).alias("b"))
    return d.select("sources", (F.abs(F.col("a") - F.col("b")) <= 0.05 * F.col("b")).alias("close"))


def length_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy("source").agg(corpus.mad(F.col("n_chars").cast("double")).alias("mad"))


def append_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokens(spark, sf_dir).select("doc_id", F.concat("ids", F.array(F.lit(0))).alias("ids"))
    return t.select("doc_id", F.size("ids").cast("long").alias("n"), F.element_at("ids", -1).cast("long").alias("last"))


def every_seventh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.every_kth(_docs(spark, sf_dir).select("doc_id"), 7, "doc_id")


def weighted_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.weighted_sample(_docs(spark, sf_dir).select("doc_id", "n_chars"), 50, 336, "doc_id", "n_chars").select("doc_id")


def embedding_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return e.select("vec_id", F.round(F.array_max(corpus.softmax("x")), 6).alias("top"), F.round(corpus.rms("x"), 6).alias("rms"))


def stripped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.regexp_replace("source", "^src", "").alias("name"))


def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 512 tokens that a batch of 128 needs, and its tokens, by source."""
    t = _tokens(spark, sf_dir).join(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum(F.size("ids")).alias("tokens"))
    return t.select("source", "tokens", F.ceil(F.col("tokens") / 512).alias("windows"), (F.ceil(F.col("tokens") / 512 / 128) * 512 * 128).alias("budget"))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "gopher_metrics": gopher_metrics,
    "gopher_keep": gopher_keep,
    "mask_emails": _mask(pii.mask_emails),
    "mask_ips": _mask(pii.mask_ips),
    "mask_phones": _mask(pii.mask_phones),
    "mask_all": mask_all,
    "line_freq": line_freq,
    "line_dedup": line_dedup,
    "exact_doc_dedup": exact_doc_dedup,
    "word_ngrams": word_ngrams_count,
    "minhash_signature": minhash_signature,
    "lsh_candidates": lsh_candidates,
    "near_dup_pairs": near_dup_pairs,
    "near_dup_clusters": near_dup_clusters,
    "minhash_dedup": minhash_dedup,
    "langid_rules": langid_rules,
    "english_filter": english_filter,
    "filter_stats": filter_stats,
    "sample_docs": sample_docs,
    "chunk_docs": chunk_docs,
    "chunk_files": chunk_files,
    "extract_urls": extract_urls,
    "document_urls": document_urls,
    "url_hosts": url_hosts,
    "distinct_sources": distinct_sources,
    "html_text": html_text,
    "html_layout": html_layout,
    "classify_quality": _trained("quality", "cc", "wiki"),
    "classify_toxic": _trained("toxic", "non-toxic", "toxic"),
    "classify_toxic_words": classify_toxic_words,
    "classify_nsfw": classify_nsfw,
    "pack_windows": pack_windows,
    "random_windows": random_windows,
    "context_suffix": context_suffix,
    "top_documents": top_documents,
    "cosine_lr": cosine_lr,
    "mean_by_label": mean_by_label,
    "set_operations": set_operations,
    "event_windows": event_windows,
    "cleaning_pipeline": cleaning_pipeline,
    "toxic_filter": toxic_filter,
    "source_rollup": source_rollup,
    "label_cube": label_cube,
    "length_quantiles": length_quantiles,
    "approx_sources": approx_sources,
    "length_spread": length_spread,
    "append_token": append_token,
    "every_seventh": every_seventh,
    "weighted_docs": weighted_docs,
    "embedding_softmax": embedding_softmax,
    "stripped_names": stripped_names,
    "token_budget": token_budget,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from siftlake.plans.oracle import SQL

    return dict(SQL)
