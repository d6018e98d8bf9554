"""DuckDB SQL for the queries of the catalogue that SQL can express, written apart from the DataFrame code."""

from __future__ import annotations

from siftlake.functions import langid, pii
from siftlake.models import classifier

_WORDS = "list_filter(regexp_split_to_array({t}, '[ \\t\\n\\r]+'), lambda w: w <> '')"


def _words(text: str) -> str:
    return _WORDS.format(t=text)


_LINES = "string_split(regexp_replace(text, '\\n$', ''), chr(10))"


def _mask(p: str, to: str) -> str:
    return f"SELECT doc_id, regexp_replace(text, '{p}', '{to}', 'g') AS text, len(regexp_extract_all(text, '{p}'))::BIGINT AS n FROM documents"




def _replace(t: str, pattern: str, to: str) -> str:
    return f"regexp_replace({t}, '{pattern}', '{to}', 'g')"


_ALL = _replace(_replace(_replace("text", pii.EMAIL, pii.EMAIL_TOKEN), pii.IPV4, pii.IP_TOKEN), pii.PHONE, "\\1" + pii.PHONE_TOKEN)

_GOPHER = """m AS (SELECT doc_id, text, @words AS w, @lines AS l FROM @src),
g AS (SELECT doc_id, text, len(w) AS n_words,
 CASE WHEN len(w) = 0 THEN 0.0 ELSE list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / len(w) END AS mean_word_length,
 len(list_filter(l, lambda x: regexp_matches(x, '([.]{3}|\u2026)[ \\t\\r]*$')))::DOUBLE / len(l) AS ellipsis_share,
 CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_filter(w, lambda x: regexp_matches(x, '\\p{L}')))::DOUBLE / len(w) END AS alpha_share,
 len(list_intersect(['the','be','to','of','and','that','have','with'], list_transform(w, lambda x: lower(x)))) AS stop_words,
 CASE WHEN len(w) = 0 THEN 0.0 ELSE len(regexp_extract_all(text, '#|[.]{3}|\u2026'))::DOUBLE / len(w) END AS symbol_ratio,
 len(list_filter(l, lambda x: regexp_matches(x, '^[ \\t]*[-*\u2022]')))::DOUBLE / len(l) AS bullet_share FROM m),
k AS (SELECT *, n_words BETWEEN 50 AND 100000 AND mean_word_length BETWEEN 3 AND 10 AND ellipsis_share <= 0.3 AND alpha_share >= 0.8 AS keep FROM g)"""


def _gopher(src: str) -> str:
    return _GOPHER.replace("@words", _words("text")).replace("@lines", _LINES).replace("@src", src)


_SHINGLES = f"""w AS (SELECT doc_id, {_words("lower(text)")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w WHERE len(w) > 0)"""

_LINE_DEDUP = f"""WITH src AS (@src),
l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, {_LINES} AS x FROM src WHERE text <> '')),
u AS (SELECT line FROM l GROUP BY line HAVING count(*) = 1),
r AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM l JOIN u USING (line) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN r.t IS NULL THEN CASE WHEN d.text IS NULL THEN NULL ELSE '' END WHEN suffix(d.text, chr(10)) THEN r.t || chr(10) ELSE r.t END AS text FROM src d LEFT JOIN r USING (doc_id)"""

_PAIRS = f"""{_SHINGLES},
n AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(1) ORDER BY s)) AS c FROM s GROUP BY doc_id),
rep AS (SELECT min(doc_id) AS doc_id, any_value(n) AS n FROM n GROUP BY c),
q AS (SELECT s.doc_id, s.s FROM s JOIN rep USING (doc_id)),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM q x JOIN q y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
p AS MATERIALIZED (SELECT a, b, k / (ra.n + rb.n - k)::DOUBLE AS jaccard FROM c JOIN rep ra ON ra.doc_id = a JOIN rep rb ON rb.doc_id = b WHERE k / (ra.n + rb.n - k)::DOUBLE >= 0.8)"""

_CLUSTERS = f"""{_PAIRS},
e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p UNION ALL SELECT n.doc_id, m.doc_id FROM n JOIN (SELECT c, min(doc_id) AS doc_id FROM n GROUP BY c) m USING (c) UNION ALL SELECT m.doc_id, n.doc_id FROM n JOIN (SELECT c, min(doc_id) AS doc_id FROM n GROUP BY c) m USING (c)),
t(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT t.x, e.b FROM t JOIN e ON e.a = t.y)"""

_HTML = """trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<(script|style|head|nav|footer)(\\s[^>]*)?>.*?</(script|style|head|nav|footer)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&middot;', '\u00b7'), '&copy;', '\u00a9'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\n\\r]+', ' ', 'g'))"""

_URL = "list_transform(regexp_extract_all(replace(replace(replace({t}, '&lt;', '<'), '&gt;', '>'), '&amp;', '+'), '((https?|telnet|gopher|file|wais|ftp)://[A-Za-z0-9_/#~:.?+=%@!;,*()-]+)'), lambda u: regexp_replace(u, '[.:?,;!)-]+$', ''))"


def _langid() -> str:
    found = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda x: true)"
    evidence = [f"{{'score': len(regexp_extract_all(text, '[{r}]')), 'label': '{k}'}}" for k, r in langid.SCRIPTS.items()]
    evidence += [f"{{'score': 4 * len(list_filter(f, lambda x: x IN ({', '.join(repr(w) for w in v)}))), 'label': '{k}'}}" for k, v in langid.WORDS.items()]
    return f"""WITH f AS (SELECT doc_id, text, {found} AS f FROM documents), e AS (SELECT doc_id, [{", ".join(evidence)}] AS e FROM f),
b AS (SELECT doc_id, list_max(e) AS m, list_sum(list_transform(e, lambda x: x.score)) AS total FROM e)
SELECT doc_id, CASE WHEN m.score > 0 THEN m.label ELSE 'und' END AS label, round(CASE WHEN m.score > 0 THEN m.score / total::DOUBLE ELSE 0.01 END, 6) AS score FROM b"""


def _lexicon(terms: tuple[str, ...], negative: str, positive: str, share: float, masked: bool = False) -> str:
    extra = f"+ len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}*]+'), lambda x: contains(x, '*') AND length(replace(x, '*', '')) >= 2 AND regexp_matches(x, '{classifier.masked_pattern(terms)}')))" if masked else ""
    return f"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN 0.0 ELSE (len(list_filter(w, lambda x: x IN ({", ".join(repr(t) for t in terms)}))) {extra})::DOUBLE / len(w) END AS s FROM w)
SELECT doc_id, CASE WHEN s > {share} THEN '{positive}' ELSE '{negative}' END AS label, round(CASE WHEN s > {share} THEN least(0.5 + s, 1.0) ELSE 1.0 - s END, 6) AS score FROM s"""


_IDS = f"SELECT doc_id, list_transform({_words('text')}, lambda w: length(w)) AS ids FROM documents"

_EXACT = _langid().replace("round(", "(").replace(", 6) AS score", ") AS score")

SQL: dict[str, str] = {
    "gopher_metrics": f"WITH {_gopher('documents')} SELECT doc_id, n_words, round(mean_word_length, 6) AS mean_word_length, round(ellipsis_share, 6) AS ellipsis_share, round(alpha_share, 6) AS alpha_share, stop_words, round(symbol_ratio, 6) AS symbol_ratio, round(bullet_share, 6) AS bullet_share, keep FROM k",
    "gopher_keep": f"WITH {_gopher('documents')} SELECT doc_id, text FROM k WHERE keep",
    "mask_emails": _mask(pii.EMAIL, pii.EMAIL_TOKEN),
    "mask_ips": _mask(pii.IPV4, pii.IP_TOKEN),
    "mask_phones": _mask(pii.PHONE, "\\1" + pii.PHONE_TOKEN),
    "mask_all": f"SELECT doc_id, {_ALL} AS text FROM documents",
    "line_freq": f"SELECT line, count(*) AS count FROM (SELECT unnest({_LINES}) AS line FROM documents WHERE text <> '') GROUP BY line",
    "line_dedup": _LINE_DEDUP.replace("@src", "SELECT doc_id, text FROM documents"),
    "exact_doc_dedup": "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text",
    "word_ngrams": f"WITH w AS (SELECT doc_id, {_words('lower(text)')} AS w FROM documents), g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END AS g FROM w) SELECT doc_id, len(g) AS n, len(list_distinct(g)) AS n_distinct FROM g",
    "minhash_signature": f"WITH {_SHINGLES} SELECT doc_id, " + ", ".join(f"min(md5('{i}|' || s)) AS h{i}" for i in range(4)) + " FROM s GROUP BY doc_id",
    "near_dup_pairs": f"WITH {_PAIRS} SELECT a, b, round(jaccard, 6) AS jaccard FROM p",
    "near_dup_clusters": f"WITH RECURSIVE {_CLUSTERS} SELECT x AS doc_id, min(y) AS cluster FROM t GROUP BY x",
    "minhash_dedup": f"WITH RECURSIVE {_CLUSTERS}, k AS (SELECT x AS doc_id, min(y) AS cluster FROM t GROUP BY x) SELECT doc_id, text FROM documents JOIN k USING (doc_id) WHERE cluster = doc_id",
    "langid_rules": _langid(),
    "english_filter": f"WITH p AS ({_EXACT}) SELECT doc_id, text FROM documents JOIN p USING (doc_id) WHERE label = 'en' AND score >= 0.7",
    "filter_stats": f"WITH p AS ({_EXACT}), d AS (SELECT source, text, label = 'en' AND score >= 0.7 AS keep FROM documents JOIN p USING (doc_id)) SELECT source AS chunk, sum(length(text))::BIGINT AS total_chars, coalesce(sum(length(text)) FILTER (NOT keep), 0)::BIGINT AS skipped_chars, round(coalesce(100.0::DOUBLE * sum(length(text)) FILTER (keep) / sum(length(text)), 0), 6) AS kept_percent FROM d GROUP BY source",
    "sample_docs": "SELECT doc_id, source FROM documents ORDER BY md5('336|' || doc_id), doc_id LIMIT 100",
    "chunk_docs": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, (row_number() OVER (ORDER BY doc_id) - 1) // 4 AS chunk FROM documents",
    "chunk_files": "SELECT page_id, format('{:05d}-{}', row_number() OVER (ORDER BY page_id) - 1, string_split(url, '/')[-1]) AS link FROM pages",
    "extract_urls": f"SELECT page_id, unnest({_URL.format(t='url')}) AS url FROM pages",
    "document_urls": f"SELECT doc_id, unnest({_URL.format(t='text')}) AS url FROM documents",
    "url_hosts": "SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1",
    "distinct_sources": "SELECT DISTINCT source FROM documents",
    "html_text": f"SELECT page_id, {_HTML} AS text FROM pages",
    "classify_nsfw": _lexicon(classifier.NSFW, "non-nsfw", "nsfw", 0.02, masked=True),
    "classify_toxic_words": _lexicon(classifier.TOXIC, "non-toxic", "toxic", 0.08),
    "pack_windows": f"WITH t AS ({_IDS}), s AS (SELECT doc_id, ids, unnest(range(0, greatest(len(ids) - 32, 0), 32)) AS start FROM t) SELECT doc_id, start, 32::BIGINT AS n, list_sum(ids[start + 1:start + 32])::BIGINT AS sum_x, list_sum(ids[start + 2:start + 33])::BIGINT AS sum_y FROM s",
    "random_windows": f"WITH t AS ({_IDS}), r AS (SELECT doc_id, ids, unnest([0, 1])::BIGINT AS draw FROM t WHERE len(ids) > 32), s AS (SELECT doc_id, ids, draw, ('0x' || substr(md5('336|' || doc_id || '|' || draw), 1, 12))::BIGINT % (len(ids) - 32) AS start FROM r) SELECT doc_id, draw, start, 32::BIGINT AS n, list_sum(ids[start + 1:start + 32])::BIGINT AS sum_x, list_sum(ids[start + 2:start + 33])::BIGINT AS sum_y FROM s",
    "context_suffix": f"WITH t AS ({_IDS}) SELECT doc_id, least(len(ids), 16) AS n, coalesce(list_sum(ids[greatest(len(ids) - 16, 0) + 1:]), 0)::BIGINT AS sum_last, coalesce(nullif(list_position(ids, 12), 0) - 1, len(ids))::BIGINT AS n_before FROM t",
    "top_documents": "SELECT source, doc_id, n_chars, rank FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 3",
    "cosine_lr": "SELECT doc_id, round(CASE WHEN doc_id < 100 THEN doc_id / 100.0::DOUBLE WHEN doc_id > 800 THEN 0.1::DOUBLE ELSE 0.1::DOUBLE + 0.5::DOUBLE * (1 + cos(pi() * (doc_id - 100) / 700.0::DOUBLE)) * 0.9::DOUBLE END, 6) AS rate FROM documents",
    "mean_by_label": "SELECT quality, toxic, count(*) AS n, round(avg(n_chars), 6) AS mean_chars, sum(n_chars)::BIGINT AS sum_chars FROM documents JOIN labels USING (doc_id) GROUP BY ALL",
    "set_operations": "SELECT doc_id AS id FROM labels WHERE toxic = 0 AND doc_id IN (SELECT doc_id FROM documents) AND doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src0') UNION ALL SELECT item_id FROM benchmark",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "cleaning_pipeline": "WITH c AS (" + _LINE_DEDUP.replace("@src", f"WITH {_gopher('(SELECT documents.* FROM documents JOIN (' + _EXACT + ') USING (doc_id) WHERE label = ' + chr(39) + 'en' + chr(39) + ' AND score >= 0.7)')} SELECT doc_id, {_ALL} AS text FROM k WHERE keep") + ") SELECT min(doc_id) AS doc_id, text FROM c WHERE text <> '' GROUP BY text",
    "toxic_filter": "WITH p AS (" + _lexicon(classifier.TOXIC, "non-toxic", "toxic", 0.08).replace("round(", "(").replace(", 6) AS score", ") AS score") + ") SELECT doc_id, text FROM documents JOIN p USING (doc_id) WHERE label = 'non-toxic' AND score >= 0.95",
    "source_rollup": "SELECT lang, source, grouping(lang, source)::BIGINT AS level, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang, source)",
    "label_cube": "SELECT quality, toxic, grouping(quality, toxic)::BIGINT AS level, count(*) AS n FROM labels GROUP BY CUBE (quality, toxic)",
    "length_quantiles": "SELECT lang, round(quantile_cont(n_chars, 0.25), 6) AS q1, round(quantile_cont(n_chars, 0.5), 6) AS q2, round(quantile_cont(n_chars, 0.75), 6) AS q3 FROM documents GROUP BY lang",
    "approx_sources": "SELECT count(DISTINCT source) AS sources, true AS close FROM documents",
    "length_spread": "WITH m AS (SELECT source, median(n_chars) AS m FROM documents GROUP BY source) SELECT source, median(abs(n_chars - m)) AS mad FROM documents JOIN m USING (source) GROUP BY source",
    "append_token": f"WITH t AS ({_IDS}) SELECT doc_id, len(ids) + 1 AS n, 0::BIGINT AS last FROM t",
    "every_seventh": "SELECT doc_id, pos FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) WHERE pos % 7 = 0",
    "weighted_docs": "SELECT doc_id FROM documents WHERE n_chars > 0 ORDER BY -ln((('0x' || substr(md5('336|' || doc_id), 1, 12))::BIGINT + 1)::DOUBLE / 281474976710657.0::DOUBLE) / n_chars, doc_id LIMIT 50",
    "embedding_softmax": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), s AS (SELECT vec_id, x, list_max(x) AS m FROM e) SELECT vec_id, round(1.0::DOUBLE / list_sum(list_transform(x, lambda v: exp(v - m))), 6) AS top, round(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)), 6) AS rms FROM s",
    "stripped_names": "SELECT doc_id, regexp_replace(source, '^src', '') AS name FROM documents",
    "token_budget": f"WITH t AS ({_IDS}), s AS (SELECT source, sum(len(ids))::BIGINT AS tokens FROM t JOIN documents USING (doc_id) GROUP BY source) SELECT source, tokens, ceil(tokens / 512.0::DOUBLE)::BIGINT AS windows, (ceil(tokens / 512.0::DOUBLE / 128) * 512 * 128)::BIGINT AS budget FROM s",
}
