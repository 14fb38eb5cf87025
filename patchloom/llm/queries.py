"""Registered queries of the corpus operators, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from patchloom.llm import (
    byte_bpe, decontaminate, divergence, language, main_text, ngram_join, passages, role_repair, simhash, suffix_dedup, surrogates, url_filter,
    vector_search)
from patchloom.llm.tools import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_filter.labelled_urls(spark))
    return url_filter.judge(table(spark, sf_dir, "pages"), model)


@query
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Stands in for a secret that a deployment would pass in.
SURROGATE_KEY = "change-me"


@query
def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace(docs, SURROGATE_KEY, count_col="n_replaced")


@query
def op3_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf_dir, "embeddings"))


ORACLES["op3_vector_search"] = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"), width=4, percent=85).drop("n_links")


ORACLES["op1_ngram_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT s.doc_id, any_value(s.n) AS n_shingles, min(r.y) AS component_id FROM sizes s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id
"""


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


@query
def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op5_suffix_dedup"] = """
WITH b AS (
  SELECT doc_id, encode(coalesce(text, '')) AS raw, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (
  SELECT doc_id, p, array_slice(raw, p + 1, p + 100) AS s
  FROM (SELECT doc_id, raw, unnest(range(0, n - 99)) AS p FROM b WHERE n >= 100)),
repeats AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
marked AS (
  SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS fresh FROM repeats),
runs AS (
  SELECT doc_id, min(p) AS a, max(p) + 100 AS z
  FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS i FROM marked) GROUP BY doc_id, i),
lists AS (SELECT doc_id, list(a ORDER BY a) AS av, list(z ORDER BY a) AS zv, sum(z - a) AS gone FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(len(av), 0) AS BIGINT) AS n_spans,
  CASE WHEN av IS NULL THEN sha256(raw) ELSE sha256(unhex(array_to_string(list_transform(range(0, len(av) + 1), lambda i:
    CASE WHEN (CASE WHEN i = 0 THEN 0 ELSE zv[i] END) < (CASE WHEN i = len(av) THEN n ELSE av[i + 1] END)
    THEN hex(array_slice(raw, (CASE WHEN i = 0 THEN 0 ELSE zv[i] END) + 1, CASE WHEN i = len(av) THEN n ELSE av[i + 1] END))
    ELSE '' END), ''))) END AS kept_sha256
FROM b LEFT JOIN lists USING (doc_id)
"""


@query
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op11_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT row_id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT row_id) >= 10),
groups AS (SELECT DISTINCT lang, source FROM d),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
held AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
counts AS (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n, k.total FROM groups g JOIN kept k USING (lang)
  LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
sizes AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL),
shares AS (
  SELECT c.lang, c.source, c.term, c.n, 1 + (CAST(1000000000 AS HUGEINT) * (c.n + 2)) // (s.n + 2 * l.v) AS p,
    1 + (CAST(1000000000 AS HUGEINT) * (c.total + 2)) // (l.n + 2 * l.v) AS q
  FROM counts c JOIN sizes s USING (lang, source) JOIN langs l USING (lang)),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN apart p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query
def op13_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = role_repair.damage(table(spark, sf_dir, "conversations"))
    return role_repair.reports(role_repair.repair(rows))


ORACLES["op13_role_repair"] = r"""
WITH RECURSIVE bits AS (
  SELECT CAST(n AS UBIGINT) AS n, CAST(n AS UBIGINT) AS c, 0 AS k FROM range(256) t(n)
  UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
codes AS (SELECT list(c ORDER BY n) AS code FROM bits WHERE k = 8),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
kinds AS (
  SELECT conv_id, turn, role, text, xor(CAST(4294967295 AS UBIGINT), list_reduce(list_prepend(CAST(4294967295 AS UBIGINT),
    list_transform(range(1, strlen(name) + 1), lambda i: CAST(ascii(substr(name, i, 1)) AS UBIGINT))),
    lambda crc, b: xor(crc >> 8, code[CAST(xor(crc, b) & 255 AS BIGINT) + 1]))) % 20 AS kind FROM named, codes),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS nth,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS said,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
talk AS (
  SELECT conv_id, turn, role, text, nth, bare = '' AS blank, bare <> '' AND said > 1 AS duplicate,
    bare <> '' AND said = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated,
    nth > 1 AND left(lag(role) OVER (PARTITION BY conv_id ORDER BY nth), 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed),
moves(state, initial, next) AS (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'p'), ('p', 'u', 'u')),
puts(state, next, n, put) AS (
  VALUES ('', '', 0, []), ('', 'u', 1, ['user:']), ('', 'p', 2, ['user:', 'assistant:']), ('s', 's', 0, []), ('s', 'u', 1, ['user:']),
    ('s', 'p', 2, ['user:', 'assistant:']), ('u', 'u', 0, []), ('u', 'p', 1, ['assistant:']), ('p', 'p', 0, []), ('p', 'u', 1, ['user:'])),
edits AS (
  SELECT t.conv_id, t.nth, s.state, s.state AS next, 4 AS price, 'D' AS letter, [] AS kept
  FROM talk t, (SELECT DISTINCT state FROM puts) s
  UNION ALL
  SELECT t.conv_id, t.nth, m.state, m.next, CASE WHEN truncated THEN 3 ELSE 0 END, 'K', [t.role || ':' || t.text]
  FROM talk t JOIN moves m ON m.initial = left(t.role, 1) WHERE NOT blank AND NOT duplicate
  UNION ALL
  SELECT t.conv_id, t.nth, m.state, m.next, CASE WHEN truncated THEN 6 ELSE 3 END, 'R',
    [CASE m.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || t.text]
  FROM talk t JOIN moves m ON m.initial IN ('u', 'a') WHERE NOT blank AND NOT duplicate),
paths AS (
  SELECT c.conv_id, CAST(0 AS BIGINT) AS nth, p.next AS state, 3 * p.n AS cost, repeat('I', p.n) AS audit, CAST(p.put AS VARCHAR[]) AS kept
  FROM (SELECT DISTINCT conv_id FROM conversations) c, puts p WHERE p.state = ''
  UNION ALL
  (SELECT h.conv_id, e.nth, p.next, h.cost + e.price + 3 * p.n, h.audit || e.letter || repeat('I', p.n),
     list_concat(list_concat(h.kept, CAST(e.kept AS VARCHAR[])), CAST(p.put AS VARCHAR[]))
   FROM paths h JOIN edits e ON e.conv_id IS NOT DISTINCT FROM h.conv_id AND e.nth = h.nth + 1 AND e.state = h.state
   JOIN puts p ON p.state = e.next
   QUALIFY row_number() OVER (PARTITION BY h.conv_id, p.next
     ORDER BY h.cost + e.price + 3 * p.n, h.audit || e.letter || repeat('I', p.n)) = 1)),
ends AS (
  SELECT * FROM paths WHERE state IN ('', 'p')
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY nth DESC, cost, audit) = 1),
sums AS (
  SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
    sum(CAST(blank AS INTEGER)) AS blank, sum(CAST(duplicate AS INTEGER)) AS duplicate, sum(CAST(truncated AS INTEGER)) AS truncated,
    sum(CAST(illegal AS INTEGER)) AS illegal FROM talk GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(cost AS BIGINT) AS cost, audit,
  sha256(array_to_string(kept, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM e.conv_id
"""
