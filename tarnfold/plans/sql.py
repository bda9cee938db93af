"""DuckDB SQL of the queries in the registry."""

from __future__ import annotations

from ..config import LANGUAGES, SKIPPED_ENDINGS, SKIPPED_FILES, SKIPPED_FOLDERS
from ..functions.text import NAMESPACE
from ..operators.generation import ABSTENTIONS, SYSTEM

PARTS = "regexp_extract_all(regexp_replace({0}, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z][a-z]+|[A-Z]+|[a-z]+|[0-9]+')"


def tokens(name: str, source: str, key: str, content: str) -> str:
    return f"""{name}_raw AS (SELECT {key}, unnest(regexp_extract_all(coalesce({content}, ''), '[A-Za-z_][A-Za-z0-9_]*|[0-9]+')) AS r FROM {source}),
{name}_parts AS (SELECT {key}, list_transform({PARTS.format('r')}, lambda x: lower(x)) AS p FROM {name}_raw),
{name} AS (SELECT {key}, unnest(CASE WHEN len(p) > 1 THEN list_append(p, array_to_string(p, '')) ELSE p END) AS term FROM {name}_parts)"""


DOCS = "docs AS (SELECT doc_id AS id, coalesce(text, '') AS text, source, lang FROM documents), asked AS (SELECT item_id AS qid, text AS query FROM benchmark)"
TOKENS = f"{DOCS}, {tokens('tok', 'docs', 'id', 'text')}, {tokens('qtok', 'asked', 'qid', 'query')}"
POSTINGS = """post AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
weights0 AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post GROUP BY 1),
weights AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM weights0) ELSE raw END AS idf FROM weights0)"""
BM25 = f"""{POSTINGS},
lens AS (SELECT id, sum(tf) AS dl FROM post GROUP BY 1),
mean AS (SELECT sum(dl) / (SELECT count(*) FROM docs) AS avgdl FROM lens),
bm_s AS (SELECT qid, id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM (SELECT qid, term, count(*) AS times FROM qtok GROUP BY 1, 2) JOIN weights USING (term) JOIN post USING (term) JOIN lens USING (id), mean GROUP BY 1, 2),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 8) DESC, id)::INT AS rank FROM bm_s) WHERE rank <= 20 AND score > 0)"""


def embedded(name: str, source: str, key: str, dim: int = 64) -> str:
    return f"""{name}_h AS (SELECT {key}, ('0x' || substr(md5(term), 1, 8))::BIGINT AS h FROM {source}),
{name}_c AS (SELECT {key}, (h % {dim})::INT AS dim, sum(CASE WHEN (h // {dim}) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM {name}_h GROUP BY 1, 2),
{name} AS (SELECT {key}, dim, CASE WHEN n = 0 THEN v ELSE v / n END AS v FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY {key})) AS n FROM {name}_c))"""


def ranks(name: str, source: str, k: int, by: str = "round(score, 8) DESC, id") -> str:
    return f"{name} AS (SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {by})::INT AS rank FROM {source}) WHERE rank <= {k})"


VECTOR = f"""{embedded('dv', 'tok', 'id')}, {embedded('qv', 'qtok', 'qid')},
vec_s AS (SELECT qid, id, sum(a.v * b.v) AS score FROM qv a JOIN dv b USING (dim) GROUP BY 1, 2),
{ranks('vec', 'vec_s', 20)}"""
SCALED = """sv AS (SELECT qid, id, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS v FROM (SELECT *, min(score) OVER (PARTITION BY qid) AS lo, max(score) OVER (PARTITION BY qid) AS hi FROM vec)),
sw AS (SELECT qid, id, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS w FROM (SELECT *, min(score) OVER (PARTITION BY qid) AS lo, max(score) OVER (PARTITION BY qid) AS hi FROM bm)),
pair AS (SELECT qid, id, coalesce(v, 0.0) AS v, coalesce(w, 0.0) AS w FROM sv FULL JOIN sw USING (qid, id))"""
RRF = f"""rrf_s AS (SELECT qid, id, sum(1.0 / (60 + rank)) AS score FROM (SELECT qid, id, rank FROM vec UNION ALL SELECT qid, id, rank FROM bm) GROUP BY 1, 2),
{ranks('rrf', 'rrf_s', 20, 'round(score, 12) DESC, id')}"""
SETS = "qset AS (SELECT qid, list(DISTINCT term) AS q FROM qtok GROUP BY 1), dset AS (SELECT id, list(DISTINCT term) AS t FROM tok GROUP BY 1)"


def reranked(name: str, source: str) -> str:
    return f"""{name}_s AS (SELECT qid, id, CASE WHEN q IS NULL THEN 0.0 ELSE len(list_intersect(q, coalesce(t, []))) / len(q) END AS score FROM {source} LEFT JOIN qset USING (qid) LEFT JOIN dset USING (id)),
{ranks(name, f'{name}_s', 5)}"""


GREP = f"""terms AS (SELECT qid, list(term) AS t FROM qtok WHERE length(term) > 2 GROUP BY 1),
low AS (SELECT id, lower(text) AS l FROM docs),
grep_s AS (SELECT qid, id, len(list_filter(t, lambda x: contains(l, x))) / len(t) AS score FROM low, terms),
grep_p AS (SELECT * FROM grep_s WHERE score > 0), {ranks('grep', 'grep_p', 5)}"""
RANDOM = f"rnd_s AS (SELECT qid, id, 0.0::DOUBLE AS score, sha256(query || '|' || id::VARCHAR) AS place FROM docs, asked), {ranks('rnd', 'rnd_s', 5, 'place, id')}"
GOLD = """gold AS (SELECT qid, id, CASE WHEN quality = 0 THEN 1 ELSE 2 END AS grade FROM docs JOIN asked ON contains(text, query)
  LEFT JOIN (SELECT doc_id AS id, min(quality) AS quality FROM labels GROUP BY 1) USING (id))"""
SHOW = "SELECT qid, id AS item, rank, round(score, 6) AS score FROM "


def metrics(k: int) -> str:
    """names (retriever, qid), hits (retriever, qid, id, rank, score), gold (qid, id, grade) -> per_query."""
    return f"""best AS (SELECT qid, id, max(grade) AS grade FROM gold GROUP BY 1, 2),
found AS (SELECT h.*, coalesce(b.grade, 0) AS g FROM hits h LEFT JOIN best b USING (qid, id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, id) AS place FROM gold),
ideal AS (SELECT qid, count(*) AS n_labels, sum(CASE WHEN place <= {k} THEN (pow(2.0, grade) - 1) / log2(place + 1) END) AS ideal FROM placed GROUP BY 1),
per AS (SELECT retriever, qid, max((g > 0 AND rank <= 1)::INT) AS hit_1, max((g > 0 AND rank <= {k})::INT) AS hit_k, sum((g > 0 AND rank <= {k})::INT) AS n_good,
  min(CASE WHEN g > 0 THEN rank END) AS first, sum(CASE WHEN rank <= {k} THEN (pow(2.0, g) - 1) / log2(rank + 1) END) AS dcg, max(CASE WHEN rank = 1 THEN score END) AS top, string_agg(CASE WHEN g > 0 THEN rank::VARCHAR END, ' ' ORDER BY rank) AS good FROM found GROUP BY 1, 2),
per_query AS (SELECT n.retriever, n.qid, coalesce(n_labels, 0)::BIGINT AS n_labels, coalesce(hit_1, 0)::INT AS hit_1, coalesce(hit_k, 0)::INT AS hit_k, coalesce(n_good / n_labels, 0.0) AS recall,
  coalesce(n_good, 0) / {k} AS precision, coalesce(1 / first, 0.0) AS rr, coalesce(CASE WHEN ideal > 0 THEN dcg / ideal END, 0.0) AS ndcg, coalesce(top, 0.0) AS top_score, coalesce(good, '') AS good_ranks
  FROM names n LEFT JOIN per USING (retriever, qid) LEFT JOIN ideal ON ideal.qid = n.qid)"""


SUMMARY = """sum((n_labels > 0)::INT)::BIGINT AS queries, {means}, sum((n_labels = 0)::INT)::BIGINT AS unanswerable,
round(coalesce(avg(CASE WHEN n_labels = 0 THEN (top_score >= 0.3)::INT END), 0.0), 6) AS false_confidence""".format(
    means=", ".join(f"round(coalesce(avg(CASE WHEN n_labels > 0 THEN {a} END), 0.0), 6) AS {b}" for a, b in (("hit_1", "hit_1"), ("hit_k", "hit_k"), ("recall", "recall"), ("rr", "mrr"), ("ndcg", "ndcg")))
)

KNN = """q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 20 = 0),
b AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
s AS (SELECT qid, id, b.label AS label, q.label AS own, list_dot_product(q.v, b.v) AS score FROM q JOIN b ON id <> qid)"""
KNN_EVAL = f"""{KNN}, {ranks('knn', 's', 20)},
gold AS (SELECT qid, id, 1 AS grade FROM q JOIN b USING (label) WHERE id <> qid), names AS (SELECT 'vector' AS retriever, qid FROM q)"""


def knn_eval(k: int, wide: int) -> str:
    return f"WITH {KNN_EVAL}, hits AS (SELECT 'vector' AS retriever, * FROM knn WHERE rank <= {wide}), {metrics(k)}"


WINDOW_LINE = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"
#: Parts of the made Python file before its text, before its number, after it; and of the made Markdown file.
CODE = (
    '"""A made module.\n\n    More."""\nimport os as o, re\nfrom .base import Thing as T\nBODY = """',
    '"""\n\n\nclass Box',
    ':\n    """A box.\n\n    More."""\n\n    @property\n    def sizeOf(self):\n        def inner():\n            return 1\n        return inner()\n\n    async def openLid(self):\n        return None\n\n\ndef run_{n}(x):\n    return x\n',
)
MARKS = ("intro\n# Part ", "\ntext\n```\n# not a heading\n```\n### Deep\nmore\n### Deeper\n", "\n## End ##\nlast\n")
WINDOWS = """files AS (SELECT coalesce(source, 'none') || '/doc_' || doc_id || '.txt' AS file_path, coalesce(lang, '') AS language, coalesce(text, '') AS content FROM documents),
cut0 AS (SELECT *, string_split_regex(content, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS l FROM files),
cut AS (SELECT file_path, language, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM cut0),
starts AS (SELECT *, len(l) AS n, unnest(range(0, greatest(0, ceil((len(l) - 4) / 3)::BIGINT * 3) + 1, 3)) AS s FROM cut WHERE len(l) > 0),
win0 AS (SELECT *, array_to_string(l[s + 1:s + 4], chr(10)) AS text FROM starts),
win AS (SELECT file_path, language, 'L' || (s + 1) AS symbol_name, (s + 1)::INT AS start_line, least(s + 4, n)::INT AS end_line, text FROM win0
  WHERE trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) <> ''),
chunks AS (SELECT *, file_path || '::' || symbol_name || ':' || start_line || ':fixed' AS point_key,
  replace(replace(file_path, '/', ' / '), '_', ' ') || chr(10) || language || ' window ' || symbol_name || chr(10) || 'l ' || start_line || chr(10) || chr(10) || text AS embed_text FROM win)"""
_UUID = f"""substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', ('0x' || substr(h, 17, 1))::INT + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"""
_RUNS = "list_sum(list_transform(regexp_extract_all({0}, '[A-Za-z]+|[0-9]+|[^\\sA-Za-z0-9]'), lambda w: (length(w) + 3) // 4))"


def stats(source: str, by: str) -> str:
    return f"""SELECT {by}, count(*) AS chunks, round(avg(n), 6) AS mean_tokens, (list_sort(list(n))[least(floor(0.95 * count(*))::BIGINT, count(*) - 1) + 1])::INT AS p95_tokens,
max(n)::INT AS max_tokens, sum((n > 256)::INT)::BIGINT AS truncated FROM {source} GROUP BY 1"""


HYBRID = f"WITH {TOKENS}, {BM25}, {VECTOR}"
_IN = lambda values: ", ".join(f"'{v}'" for v in values)
_ENDINGS = " OR ".join(f"ends_with(name, '{e}')" for e in SKIPPED_ENDINGS)
_LANGS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in LANGUAGES.items()) + "}"

SQL = {
    "knn_exact_topk": f"WITH {KNN}, {ranks('r', 's', 5)} {SHOW} r",
    "knn_filtered_label": f"WITH {KNN}, same AS (SELECT * FROM s WHERE label = own), {ranks('r', 'same', 5)} {SHOW} r",
    "knn_per_label_cap": f"""WITH {KNN}, {ranks('r', 's', 20)}, own AS (SELECT r.*, row_number() OVER (PARTITION BY qid, label ORDER BY rank) AS o FROM r JOIN (SELECT id, label FROM b) USING (id)),
capped AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY rank)::INT AS rank FROM own WHERE o <= 2) {SHOW} capped WHERE rank <= 5""",
    "knn_eval_metrics": f"{knn_eval(5, 10)} SELECT qid, n_labels, hit_1, hit_k, round(recall, 6) AS recall, round(precision, 6) AS precision, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg, round(top_score, 6) AS top_score, good_ranks FROM per_query",
    "knn_metrics_by_label": f"{knn_eval(5, 10)} SELECT label, count(*) AS queries, round(avg(hit_1), 6) AS hit_1, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM per_query JOIN q USING (qid) GROUP BY ROLLUP (label)",
    "knn_k_sweep": " UNION ALL ".join(f"(SELECT {k}::INT AS k, queries, hit_k, recall, mrr, ndcg FROM ({knn_eval(k, 20)} SELECT {SUMMARY} FROM per_query))" for k in (1, 3, 5, 10, 20)),
    "knn_threshold_sweep": f"""WITH {KNN_EVAL}, cuts AS (SELECT unnest([0.0, 0.1, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5])::DOUBLE AS threshold),
h AS (SELECT threshold, k.qid, max((g.id IS NOT NULL)::INT) AS hit, count(*) AS kept FROM knn k LEFT JOIN gold g USING (qid, id), cuts WHERE rank <= 5 AND round(score, 8) >= threshold GROUP BY 1, 2)
SELECT c.threshold, round(avg(coalesce(hit, 0)), 6) AS hit_kept, round(avg((kept IS NULL)::INT), 6) AS abstained, sum(coalesce(kept, 0))::BIGINT AS hits_kept FROM cuts c CROSS JOIN q LEFT JOIN h ON h.threshold = c.threshold AND h.qid = q.qid GROUP BY 1""",
    "knn_score_distribution": f"""WITH {KNN_EVAL}, v AS (SELECT g.id IS NOT NULL AS relevant, list_sort(list(round(score, 6))) AS v FROM knn LEFT JOIN gold g USING (qid, id) WHERE rank <= 5 GROUP BY 1)
SELECT relevant, len(v) AS n, v[1] AS least, v[least(floor(0.25 * len(v))::BIGINT, len(v) - 1) + 1] AS p25, v[least(floor(0.5 * len(v))::BIGINT, len(v) - 1) + 1] AS median, v[least(floor(0.75 * len(v))::BIGINT, len(v) - 1) + 1] AS p75, v[-1] AS most FROM v""",
    "tokenize_postings": f"WITH {TOKENS}, {POSTINGS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS times, max(tf) AS most FROM post GROUP BY 1",
    "term_idf": f"WITH {TOKENS}, {POSTINGS} SELECT term, df, round(idf, 6) AS idf FROM weights",
    "token_stats_by_lang": f"WITH c AS (SELECT lang, coalesce({_RUNS.format('text')}, 0)::INT AS n FROM documents) {stats('c', 'lang')}",
    "bm25_topk": f"WITH {TOKENS}, {BM25} {SHOW} bm WHERE rank <= 5",
    "grep_topk": f"WITH {TOKENS}, {GREP} {SHOW} grep",
    "random_topk": f"WITH {DOCS}, {RANDOM} {SHOW} rnd",
    "hash_embed_cells": f"WITH {TOKENS}, {VECTOR} SELECT dim, count(*) AS cells, sum(v) AS total, sum(v * v) AS squares FROM dv_c GROUP BY 1",
    "hash_embed_topk": f"WITH {TOKENS}, {VECTOR} {SHOW} vec WHERE rank <= 5",
    "cache_keys": "SELECT doc_id AS id, sha256(encode('hash-64') || '\\x00'::BLOB || encode(coalesce(text, ''))) AS key FROM documents",
    "cache_misses_dedup": """WITH k AS (SELECT doc_id, lang, md5(coalesce(text, '')) AS key FROM documents), c AS (SELECT DISTINCT key FROM k WHERE doc_id % 2 = 0)
SELECT lang, count(*) AS texts, count(c.key) AS hits, count(DISTINCT CASE WHEN c.key IS NULL THEN k.key END) AS encoded FROM k LEFT JOIN c ON c.key = k.key GROUP BY 1""",
    "fuse_weighted": f"{HYBRID}, {SCALED}, f AS (SELECT qid, id, 0.7::DOUBLE * v + (1 - 0.7::DOUBLE) * w AS score FROM pair), {ranks('r', 'f', 5)} {SHOW} r",
    "fuse_rrf": f"{HYBRID}, {RRF} {SHOW} rrf WHERE rank <= 5",
    "fuse_weight_sweep": f"""{HYBRID}, {SCALED}, f AS (SELECT x AS weight, qid, id, x * v + (1 - x) * w AS score FROM pair, (SELECT unnest([0.3, 0.5, 0.7, 0.9, 1.0])::DOUBLE AS x)),
r AS (SELECT *, row_number() OVER (PARTITION BY weight, qid ORDER BY round(score, 8) DESC, id)::INT AS rank FROM f) SELECT weight, qid, id AS item, rank, round(score, 6) AS score FROM r WHERE rank <= 5""",
    "rerank_topk": f"WITH {TOKENS}, {VECTOR}, {SETS}, {reranked('rr', 'vec')} {SHOW} rr",
    "rrf_rerank_topk": f"{HYBRID}, {RRF}, {SETS}, {reranked('rr', 'rrf')} {SHOW} rr",
    "qrels_from_passages": f"WITH {DOCS}, {GOLD} SELECT qid, id AS item, grade FROM gold",
    "qrels_integrity": f"""WITH {DOCS}, {GOLD} SELECT (SELECT count(*) FROM asked) AS questions, (SELECT count(DISTINCT qid) FROM asked) AS distinct_ids, (SELECT count(*) FROM gold) AS labels,
(SELECT count(*) FROM gold WHERE grade NOT IN (1, 2)) AS bad_grades, (SELECT count(*) FROM gold ANTI JOIN docs USING (id)) AS unresolved, (SELECT count(*) FROM asked ANTI JOIN gold USING (qid)) AS unanswerable""",
    "retriever_comparison": f"""{HYBRID}, {GREP}, {RANDOM}, {SCALED}, {RRF}, {SETS}, {reranked('vr', 'vec')}, {reranked('hr', 'rrf')}, {GOLD},
w7 AS (SELECT qid, id, 0.7::DOUBLE * v + (1 - 0.7::DOUBLE) * w AS score FROM pair), {ranks('hw', 'w7', 5)},
own AS (SELECT vec.*, row_number() OVER (PARTITION BY qid, source ORDER BY rank) AS o FROM vec JOIN docs USING (id)),
cap AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY rank)::INT AS rank FROM own WHERE o <= 2),
hits AS ({" UNION ALL ".join(f"SELECT '{n}' AS retriever, qid, id, rank, score FROM {t} WHERE rank <= 5" for n, t in (("random", "rnd"), ("grep", "grep"), ("bm25", "bm"), ("vector", "vec"), ("hybrid_weighted", "hw"), ("hybrid_rrf", "rrf"), ("vector_rerank", "vr"), ("hybrid_rrf_rerank", "hr"), ("vector_cap", "cap")))}),
names AS (SELECT retriever, qid FROM asked, (SELECT unnest(['random', 'grep', 'bm25', 'vector', 'hybrid_weighted', 'hybrid_rrf', 'vector_rerank', 'hybrid_rrf_rerank', 'vector_cap']) AS retriever)),
{metrics(5)} SELECT retriever, {SUMMARY} FROM per_query GROUP BY 1""",
    "chunk_fixed": f"WITH {WINDOWS} SELECT file_path, symbol_name, start_line, end_line, md5(text) AS text_md5 FROM chunks",
    "chunk_ids": f"WITH {WINDOWS}, i AS (SELECT *, sha1(unhex('{NAMESPACE}') || encode(point_key)) AS h FROM chunks) SELECT {_UUID} AS point_id, point_key, file_path || ':' || start_line || '-' || end_line AS citation, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS directory FROM i",
    "chunk_content_hash": f"WITH {WINDOWS} SELECT point_key, sha256(embed_text) AS content_hash FROM chunks",
    "chunk_token_stats": f"WITH {WINDOWS}, c AS (SELECT 'fixed' AS strategy, {_RUNS.format('embed_text')}::INT AS n FROM chunks) {stats('c', 'strategy')}",
    "split_identifiers": f"SELECT p_partkey, array_to_string({PARTS.format(chr(40) + chr(112) + '_brand || ' + repr('_') + ' || p_name || ' + repr('HTTPServer2x') + chr(41))}, '|') AS parts FROM part",
    "slugs": "SELECT p_partkey, regexp_replace(regexp_replace('--' || p_name || ' / ' || p_type || '!', '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part",
    "count_by_language": "SELECT lang, source, count(*) AS files, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang, source)",
    "discover_filter": f"""WITH p AS (SELECT ['src', 'node_modules', '.hidden', 'lib'][page_id % 4 + 1] AS folder, 'f' || page_id || ['.py', '.md', '.min.js', '.lock', '.TS', '_pb2.py'][page_id % 6 + 1] AS name, octet_length(encode(html))::BIGINT AS size FROM pages)
SELECT folder || '/' || name AS file_path, size, ({_LANGS})[lower(regexp_extract(name, '(\\.[^./]*)$', 1))] AS language FROM p
WHERE folder NOT IN ({_IN(SKIPPED_FOLDERS)}) AND NOT starts_with(folder, '.') AND NOT starts_with(name, '.') AND name NOT IN ({_IN(SKIPPED_FILES)}) AND NOT ({_ENDINGS}) AND size <= 20000 AND lower(regexp_extract(name, '(\\.[^./]*)$', 1)) IN ({_IN(LANGUAGES)})""",
}
_VERSIONS = """b AS (SELECT 'p' || doc_id AS point_id, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 7 <> 0),
a AS (SELECT 'p' || doc_id AS point_id, sha256(coalesce(text, '') || CASE WHEN doc_id % 10 = 1 THEN '+' ELSE '' END) AS h FROM documents WHERE doc_id % 10 <> 0),
act AS (SELECT point_id, CASE WHEN a.h IS NULL THEN 'delete' WHEN a.h = b.h THEN 'unchanged' ELSE 'upsert' END AS action FROM a FULL JOIN b USING (point_id))"""
SQL["sync_actions"] = f"WITH {_VERSIONS} SELECT point_id, action FROM act"
SQL["sync_report"] = f"""WITH {_VERSIONS} SELECT count(*) FILTER (action <> 'delete') AS chunks, count(*) FILTER (action = 'upsert') AS upserted, count(*) FILTER (action = 'unchanged') AS unchanged,
count(*) FILTER (action = 'delete') AS deleted, count(*) FILTER (action <> 'delete') AS points FROM act"""
_LINES = "(CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END)"
_BLOCKS = f"""lined0 AS (SELECT id, source, text, string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS l FROM docs),
lined AS (SELECT id, source || '/doc_' || id || '.txt:1-' || len({_LINES}) AS citation, text, {_LINES} AS l FROM lined0),
hit AS (SELECT qid, rank, citation, 'doc_' || id AS name, text, l FROM bm JOIN lined USING (id) WHERE rank <= 5)"""
SQL["context_blocks"] = f"""WITH {TOKENS}, {BM25}, {_BLOCKS}, c AS (SELECT qid, count(*) AS n, string_agg('[' || rank || '] ' || citation || '  (file ' || name || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS t FROM hit GROUP BY 1),
p AS (SELECT a.qid, coalesce(n, 0)::INT AS blocks, 'Passages' || chr(10) || chr(10) || coalesce(t, '(the search found no passages)') || chr(10) || chr(10) || 'Asked: ' || query AS p FROM asked a LEFT JOIN c USING (qid))
SELECT qid, blocks, (length(p) + {len(SYSTEM)})::INT AS prompt_chars, md5(p) AS prompt_md5 FROM p"""
SQL["extractive_answer"] = f"""WITH {TOKENS}, {BM25}, {_BLOCKS},
c AS (SELECT qid, string_agg('[' || rank || '] ' || citation || ' ' || name || chr(10) || array_to_string(l[1:12], chr(10)) || CASE WHEN len(l) > 12 THEN chr(10) || '[+ ' || (len(l) - 12) || ' lines]' ELSE '' END || chr(10), chr(10) ORDER BY rank) AS t FROM hit WHERE rank <= 3 GROUP BY 1),
p AS (SELECT a.qid, CASE WHEN t IS NULL THEN 'No passage was found, so the context is insufficient for an answer.' ELSE
  rtrim('Passages that match the question best (no model has read them):' || chr(10) || chr(10) || t, ' ' || chr(10) || chr(13) || chr(9)) END AS x FROM asked a LEFT JOIN c USING (qid))
SELECT qid, md5(x) AS answer_md5, contains(lower(x), 'insufficient') OR contains(lower(x), 'not enough context') OR contains(lower(x), 'cannot answer') OR contains(lower(x), 'does not contain') AS abstained FROM p"""
SQL["citation_check"] = """WITH a AS (SELECT doc_id, doc_id::VARCHAR AS n, coalesce(source, 'none') || '/doc_' || doc_id || '.py' AS path FROM documents)
SELECT doc_id, path || ':1-9 Doc_' || n || '.py' AS grounded, path || ':2-2' AS drifted, 'lost/file_' || n || '.md:3-4 other.rb' AS invented, CASE doc_id % 3 WHEN 0 THEN '0 7' WHEN 1 THEN '7' ELSE '2 7' END AS bad_refs FROM a"""
SQL["abstention"] = """SELECT role, count(*) AS turns, sum((contains(lower(coalesce(text, '')), 'insufficient') OR contains(lower(coalesce(text, '')), 'not enough context') OR contains(lower(coalesce(text, '')), 'cannot answer')
OR contains(lower(coalesce(text, '')), 'does not contain'))::INT)::BIGINT AS abstained FROM conversations GROUP BY 1"""
SQL["count_by_kind"] = """WITH n AS (SELECT count(*) AS n FROM documents), k AS (SELECT * FROM (VALUES ('python', 'module', 1), ('python', 'class', 1), ('python', 'method', 2), ('python', 'function', 1), ('markdown', 'module', 1), ('markdown', 'section', 4)) v(language, symbol_type, c))
SELECT language, symbol_type, sum(c * n)::BIGINT AS symbols FROM k, n GROUP BY ROLLUP (language, symbol_type)"""
_MADE = f"""src AS (SELECT doc_id::VARCHAR AS n, coalesce(text, '') AS s, len(coalesce(text, '')) - len(replace(coalesce(text, ''), chr(10), '')) AS m FROM documents),
py AS (SELECT 'pkg/mod_' || n || '.py' AS file_path, 'python' AS language, n, m, 6 + m AS e, {{code}} AS content FROM src),
md AS (SELECT 'docs/page_' || n || '.md' AS file_path, 'markdown' AS language, n, m, 0 AS e, {{marks}} AS content FROM src),
raw AS (SELECT 'raw/text_' || n || x AS file_path, k AS language, n, m, 0 AS e, s AS content FROM src, (VALUES ('.py', 'python'), ('.md', 'markdown')) v(x, k)),
made AS (FROM py UNION ALL FROM md UNION ALL FROM raw),
lined AS (SELECT *, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS lines FROM (SELECT *, string_split_regex(content, '{WINDOW_LINE}') AS l FROM made)),
shape AS (SELECT * FROM (VALUES
  ('pkg', 1, 'class', 'Box', true, 3, 15, '', false, 'A box.' || chr(10) || chr(10) || 'More.'), ('pkg', 2, 'method', 'sizeOf', false, 8, 12, 'Box', true, ''),
  ('pkg', 3, 'method', 'openLid', false, 14, 15, 'Box', true, ''), ('pkg', 4, 'function', 'run_', true, 18, 19, '', false, ''),
  ('doc', 1, 'section', 'Part ', true, 2, 6, '', false, ''), ('doc', 2, 'section', 'Deep', false, 7, 8, 'Part ', true, ''),
  ('doc', 3, 'section', 'Deeper', false, 9, NULL, 'Part ', true, ''), ('doc', 4, 'section', 'End', false, NULL, NULL, 'Part ', true, '')
) v(folder, position, symbol_type, name, numbered, first, last, owner, owned, docstring)),
symbols AS (SELECT file_path, language, n, lines, 0 AS position, 'module' AS symbol_type, regexp_extract(file_path, '[^/]+$') AS symbol_name, 1 AS start_line, greatest(len(lines), 1) AS end_line, '' AS class_name,
  CASE WHEN e > 0 THEN 'A made module.' || chr(10) || chr(10) || 'More.' ELSE '' END AS docstring, CASE WHEN e > 0 THEN 'import o, re; from .base import Thing' ELSE '' END AS imports FROM lined
  UNION ALL SELECT file_path, language, n, lines, position, symbol_type, name || CASE WHEN numbered THEN n ELSE '' END,
  CASE WHEN folder = 'pkg' THEN e + first ELSE coalesce(first, 11 + m) END, CASE WHEN folder = 'pkg' THEN e + last WHEN name = 'Deeper' THEN 10 + m ELSE coalesce(last, 12 + m) END,
  owner || CASE WHEN owned THEN n ELSE '' END || CASE WHEN name = 'Deeper' THEN ' > Deep' ELSE '' END, docstring, '' FROM lined JOIN shape ON starts_with(file_path, folder))"""


def _made() -> str:
    """The made files of the registry; m is the number of line ends in the text, e the line where the constant ends."""
    lit = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    escaped = "replace(replace(replace(s, '\\', '\\\\'), '\"', '\\\"'), chr(0), '\\x00')"
    head, middle, tail = CODE
    code = f"{lit(head)} || {escaped} || {lit(middle)} || n || {lit(tail.partition('{n}')[0])} || n || {lit(tail.partition('{n}')[2])}"
    marks = f"{lit(MARKS[0])} || n || {lit(MARKS[1])} || '> ' || replace(s, chr(10), chr(10) || '> ') || {lit(MARKS[2])}"
    return _MADE.replace("{code}", code).replace("{marks}", marks)


_KINDS = {"file": "'module'", "class": "'class', 'function', 'section'", "function": "'function', 'method', 'section'"}
_CHUNK = f"""text AS (SELECT *, array_to_string(lines[start_line:end_line], chr(10)) AS text, file_path || ':' || class_name || ':' || symbol_name || ':' || start_line || ':{{0}}' AS key,
  CASE WHEN class_name <> '' THEN class_name || '.' ELSE '' END || symbol_name AS qualified, lower(array_to_string({PARTS.format('symbol_name')}, ' ')) AS words FROM kept),
emb AS (SELECT *, sha1(unhex('{NAMESPACE}') || encode(key)) AS h, array_to_string(list_filter([replace(replace(file_path, '/', ' / '), '_', ' '), language || ' ' || symbol_type || ' ' || qualified, class_name, words, trim(docstring)], lambda x: x <> ''), chr(10)) || chr(10) || chr(10) || text AS embed_text FROM text)"""
SQL["parse_symbols"] = f"WITH {_made()} SELECT file_path, language, position::INT AS position, symbol_type, symbol_name, start_line::INT AS start_line, end_line::INT AS end_line, class_name, docstring, imports FROM symbols"


def _chunks(strategy: str) -> str:
    return f"""kept AS (SELECT * FROM symbols WHERE symbol_type IN ({_KINDS[strategy]}) OR (symbol_type = 'module' AND starts_with(file_path, 'raw/'))), {_CHUNK.format(strategy)}
SELECT '{strategy}' AS strategy, {_UUID} AS point_id, file_path || ':' || start_line || '-' || end_line AS citation, symbol_type, symbol_name, class_name, md5(embed_text) AS embed_md5 FROM emb"""


for _s in _KINDS:
    SQL[f"chunk_{_s}"] = f"WITH {_made()}, {_chunks(_s)}".replace(f"SELECT '{_s}' AS strategy, ", "SELECT ")
SQL["chunk_all"] = f"WITH {_made()} " + " UNION ALL ".join(f"SELECT * FROM (WITH {_chunks(s)})" for s in _KINDS)
SQL["context_expand"] = f"""WITH {_made()}, x AS (SELECT *, 'class Box' || n || ':' || chr(10) || '    \"\"\"A box.\"\"\"' AS head FROM symbols WHERE symbol_name = 'sizeOf')
SELECT file_path, head AS class_signature, 'import o, re; from .base import Thing' AS imports, 'openLid' AS siblings,
md5('import o, re' || chr(10) || 'from .base import Thing' || chr(10) || chr(10) || head || chr(10) || '    # other methods: openLid' || chr(10) || chr(10) || array_to_string(lines[start_line:end_line], chr(10))) AS expanded_md5 FROM x"""
_CODE = "list_transform(v, lambda x: (CASE WHEN x < 0 THEN -1 ELSE 1 END * floor(least(1.0, abs(x) / top) * 127 + 0.5))::INT)"
SQL["int8_topk"] = f"""WITH {KNN}, sizes AS (SELECT size, sum(count(*)) OVER (ORDER BY size) AS upto FROM (SELECT round(abs(unnest(v)), 4) AS size FROM b) GROUP BY 1),
scale AS (SELECT min(size) AS top FROM sizes WHERE upto >= 0.99 * (SELECT max(upto) FROM sizes)), bc AS (SELECT id, v, {_CODE} AS c FROM b, scale), qc AS (SELECT qid, v, {_CODE} AS c FROM q, scale),
rough AS (SELECT qid, id, list_dot_product(qc.v, bc.v) AS score, row_number() OVER (PARTITION BY qid ORDER BY list_dot_product(qc.c::DOUBLE[], bc.c::DOUBLE[]) DESC, id) AS n FROM qc, bc),
fine AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 8) DESC, id) AS n FROM rough WHERE n <= 44),
left_ AS (SELECT * FROM fine WHERE n <= 11 AND id <> qid), {ranks('r', 'left_', 10)} {SHOW} r"""
_PICKS = ", ".join(
    f"""w{i} AS (SELECT c.qid, c.id, {i} AS step FROM c JOIN d ON d.qid = c.qid AND d.a = c.id JOIN p{i - 1} ch ON ch.qid = c.qid AND ch.id = d.b
  WHERE NOT EXISTS (SELECT 1 FROM p{i - 1} o WHERE o.qid = c.qid AND o.id = c.id) GROUP BY c.qid, c.id, c.score, c.rank
  QUALIFY row_number() OVER (PARTITION BY c.qid ORDER BY 0.5 * c.score - 0.5 * max(d.near) DESC, c.rank) = 1), p{i} AS (FROM p{i - 1} UNION ALL FROM w{i})"""
    for i in range(2, 6)
)
SQL["mmr_topk"] = f"""WITH {KNN}, {ranks('knn', 's', 20)}, c AS (SELECT k.qid, k.id, k.rank, k.score, v FROM knn k JOIN (SELECT id, v FROM b) USING (id)),
d AS (SELECT x.qid, x.id AS a, y.id AS b, list_dot_product(x.v, y.v) AS near FROM c x JOIN c y USING (qid)), p1 AS (SELECT qid, id, 1 AS step FROM c WHERE rank = 1), {_PICKS}
SELECT p5.qid, p5.id AS item, step::INT AS rank, round(score, 6) AS score FROM p5 JOIN c USING (qid, id)"""
_FILTERED = "near AS (SELECT v.* FROM vec_s v JOIN docs USING (id) WHERE {0})"
SQL["search_filtered"] = f"WITH {TOKENS}, {VECTOR}, {_FILTERED.format("lang = 'en' AND id % 3 <> 0 AND source = 'src3'")}, {ranks('r', 'near', 5)} {SHOW} r"
SQL["search_filtered_rerank"] = f"WITH {TOKENS}, {VECTOR}, {_FILTERED.format("lang = 'en'")}, {ranks('wide', 'near', 20)}, {SETS}, {reranked('rr', 'wide')} {SHOW} rr"
_ORACLE = f"""{TOKENS}, {VECTOR}, {GOLD}, first_ AS (SELECT qid, arg_min(coalesce(lang, ''), id) AS own FROM gold JOIN docs USING (id) GROUP BY 1),
near AS (SELECT v.* FROM vec_s v JOIN docs USING (id) LEFT JOIN first_ USING (qid) WHERE own IS NULL OR coalesce(lang, '') = own), {ranks('r', 'near', 5)}"""
SQL["search_oracle_language"] = f"WITH {_ORACLE} {SHOW} r"
SQL["filter_comparison"] = f"""WITH {_ORACLE}, names AS (SELECT retriever, qid FROM asked, (VALUES ('none'), ('oracle_language')) v(retriever)),
hits AS (SELECT 'none' AS retriever, qid, id, rank, score FROM vec WHERE rank <= 5 UNION ALL SELECT 'oracle_language', qid, id, rank, score FROM r), {metrics(5)} SELECT retriever, {SUMMARY} FROM per_query GROUP BY 1"""
SQL["rerank_enriched_topk"] = f"""WITH {TOKENS}, {VECTOR}, head AS (SELECT id, lang || ' ' || source AS h FROM docs), {tokens('htok', 'head', 'id', 'h')}, qset AS (SELECT qid, list(DISTINCT term) AS q FROM qtok GROUP BY 1),
dset AS (SELECT id, list(DISTINCT term) AS t FROM (FROM tok UNION ALL FROM htok) GROUP BY 1), {reranked('rr', 'vec')} SELECT rr.qid, id AS item, rr.rank, round(vec.score, 6) AS score FROM rr JOIN vec USING (qid, id)"""
SQL["context_cost"] = f"""WITH {TOKENS}, {BM25}, n AS (SELECT id, {_RUNS.format('text')} AS n FROM docs),
p AS (SELECT k, qid, sum(n) AS t FROM bm JOIN n USING (id), (SELECT unnest([1, 3, 5, 10, 20])::INT AS k) WHERE rank <= k GROUP BY 1, 2) SELECT k, round(avg(t), 6) AS mean_tokens FROM p GROUP BY 1"""
SQL["strategy_comparison"] = f"WITH {_made()}, " + ", ".join(f"emb_{s} AS (SELECT '{s}' AS strategy, embed_text FROM (WITH {_chunks(s).replace('SELECT ' + repr(s) + ' AS strategy, ' + _UUID, 'SELECT embed_text, ' + _UUID)}))" for s in _KINDS) + f", c AS (SELECT strategy, {_RUNS.format('embed_text')}::INT AS n FROM ({' UNION ALL '.join(f'FROM emb_{s}' for s in _KINDS)})) {stats('c', 'strategy')}"
SQL["label_grades"] = f"""WITH {_made()} SELECT file_path, symbol_name, CASE WHEN (n::BIGINT % 3 = 0 AND symbol_name = 'openLid') OR (n::BIGINT % 3 = 1 AND symbol_name = 'sizeOf') OR n::BIGINT % 3 = 2 THEN 2 ELSE 0 END AS grade
FROM symbols WHERE starts_with(file_path, 'pkg/')"""
SQL["label_index"] = f"WITH {_made()} SELECT DISTINCT file_path AS file, unnest([symbol_name, CASE WHEN class_name <> '' THEN class_name || '.' ELSE '' END || symbol_name]) AS name FROM symbols WHERE starts_with(file_path, 'pkg/')"
SQL["retriever_comparison_mmr"] = f"""WITH {TOKENS}, {VECTOR}, {GOLD}, c AS (SELECT qid, id, rank, score FROM vec),
d AS (SELECT x.qid, x.id AS a, y.id AS b, sum(p.v * q.v) AS near FROM c x JOIN c y USING (qid) JOIN dv p ON p.id = x.id JOIN dv q ON q.id = y.id AND q.dim = p.dim GROUP BY 1, 2, 3),
p1 AS (SELECT qid, id, 1 AS step FROM c WHERE rank = 1), {_PICKS}, hits AS (SELECT 'vector_mmr' AS retriever, p5.qid, p5.id, step AS rank, score FROM p5 JOIN c USING (qid, id)),
names AS (SELECT 'vector_mmr' AS retriever, qid FROM asked), {metrics(5)} SELECT retriever, {SUMMARY} FROM per_query GROUP BY 1"""
_MARKS = " OR ".join(f"contains(lower(x), '{m}')" for m in ABSTENTIONS)
SQL["rag_probe"] = f"""WITH {TOKENS}, {BM25}, {_BLOCKS}, v AS (SELECT * FROM (VALUES ('one', 1), ('three', 3)) v(variant, m)),
c AS (SELECT variant, qid, count(*) AS n, string_agg(array_to_string(l[1:12], chr(10)), chr(10)) AS x FROM hit, v WHERE rank <= m GROUP BY 1, 2),
a AS (SELECT variant, a.qid, coalesce(n, 0) AS n, coalesce(x, 'insufficient') AS x FROM asked a CROSS JOIN v LEFT JOIN c USING (variant, qid))
SELECT variant, count(*) AS questions, sum(({_MARKS})::INT)::BIGINT AS abstained, sum(n)::BIGINT AS grounded, 0::BIGINT AS drifted, 0::BIGINT AS invented, count(*) AS ok FROM a GROUP BY 1"""
_MODELS = ", ".join(f"""{embedded(f'd{n}', 'tok', 'id', n)}, {embedded(f'q{n}', 'qtok', 'qid', n)},
s{n} AS (SELECT qid, id, sum(a.v * b.v) AS score FROM q{n} a JOIN d{n} b USING (dim) GROUP BY 1, 2), {ranks(f'v{n}', f's{n}', 5)}""" for n in (16, 64, 256))
SQL["model_comparison"] = f"""WITH {TOKENS}, {_MODELS}, {GOLD}, names AS (SELECT retriever, qid FROM asked, (VALUES ('hash-16'), ('hash-64'), ('hash-256')) v(retriever)),
hits AS ({' UNION ALL '.join(f"SELECT 'hash-{n}' AS retriever, qid, id, rank, score FROM v{n}" for n in (16, 64, 256))}), {metrics(5)} SELECT retriever, {SUMMARY} FROM per_query GROUP BY 1"""
