"""Queries over replies: extraction, application, retries, schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom.operators import chunks, replies
from patchloom.plans.registry import query, read


def _fenced(spark, sf_dir):
    said = read(spark, sf_dir, "conversations").filter("role = 'assistant'")
    n = F.col("conv_id") % 4
    text = (
        F.when(n == 0, F.concat(F.lit("Here:\n```python\n"), "text", F.lit("\n```\nDone.")))
        .when(n == 1, F.concat(F.lit("```\n"), "text", F.lit("\n```")))
        .when(n == 2, F.concat(F.lit("```c++\n"), "text", F.lit("\n```")))
        .otherwise(F.concat(F.lit("  "), "text", F.lit(" \n")))
    )
    reply = F.when(F.col("turn") == 3, F.lit("```\n\n```")).otherwise(text)
    return said.select(F.col("conv_id").alias("file"), F.col("turn").alias("prompt_id"), reply.alias("reply"))


CODE = """
coded AS (
  SELECT conv_id AS file, turn AS prompt_id,
    CASE WHEN turn = 3 THEN '' ELSE CASE conv_id % 4 WHEN 2 THEN '```c++' || chr(10) || text || chr(10) || '```'
      ELSE trim(text, ' ' || chr(10) || chr(9)) END END AS code
  FROM conversations WHERE role = 'assistant')"""


@query("reply_code_block", f"WITH {CODE} SELECT file, prompt_id, code FROM coded WHERE code <> ''")
def reply_code_block(spark, sf_dir):
    return replies.single_code(_fenced(spark, sf_dir))[0].select("file", "prompt_id", "code")


@query("apply_counts", f"""
WITH {CODE}
SELECT file, count(*) AS prompts, count(*) FILTER (code <> '') AS applied, count(*) FILTER (code <> '') = 0 AS failed FROM coded GROUP BY 1""")
def apply_counts(spark, sf_dir):
    made = _fenced(spark, sf_dir)
    return replies.apply_counts(made, replies.single_code(made)[0])


def _blocks(spark, sf_dir):
    """Three blocks per assistant turn; the last one repeats an id on even turns."""
    said = read(spark, sf_dir, "conversations").filter("role = 'assistant'")
    turn = F.col("turn")
    block = lambda i, body: F.concat(F.lit('<chunk id="chunk_'), i.cast("string"), F.lit('">\n'), body, F.lit("\n</chunk>\n"))
    reply = F.concat(
        block(turn % 3, F.col("text")),
        block((turn + 1) % 3, F.concat(F.lit("```python\n"), F.lit("second "), F.col("text"), F.lit("\n```"))),
        block(F.when(turn % 2 == 0, turn % 3).otherwise((turn + 2) % 3), F.concat(F.lit("last "), F.col("text"))),
    )
    return said.select(F.col("conv_id").alias("file"), turn.alias("prompt_id"), reply.alias("reply"))


def _expected(spark, sf_dir):
    said = read(spark, sf_dir, "conversations").filter("role = 'assistant'")
    ids = F.array(*[F.lit(f"chunk_{i}") for i in range(4)])
    return said.select(F.col("conv_id").alias("file"), F.col("turn").alias("prompt_id"), F.explode(ids).alias("chunk_id"))


BLOCKS = """
said AS (SELECT conv_id AS file, turn AS prompt_id, trim(text, ' ' || chr(10)) AS text, text AS raw FROM conversations WHERE role = 'assistant'),
blocks AS (
  SELECT file, prompt_id, 'chunk_' || prompt_id % 3 AS chunk_id, text AS code FROM said WHERE prompt_id % 2 = 1
  UNION ALL SELECT file, prompt_id, 'chunk_' || (prompt_id + 1) % 3, trim('second ' || raw, ' ' || chr(10)) FROM said
  UNION ALL SELECT file, prompt_id, 'chunk_' || CASE WHEN prompt_id % 2 = 0 THEN prompt_id % 3 ELSE (prompt_id + 2) % 3 END, trim('last ' || raw, ' ' || chr(10)) FROM said),
expected AS (SELECT file, prompt_id, 'chunk_' || unnest([0, 1, 2, 3]) AS chunk_id FROM said)"""


@query("reply_batched_blocks", f"WITH {BLOCKS} SELECT file, prompt_id, chunk_id, code FROM blocks")
def reply_batched_blocks(spark, sf_dir):
    return replies.batched_blocks(_blocks(spark, sf_dir))


@query("reply_missing_chunks", f"""
WITH {BLOCKS}
SELECT e.file, e.prompt_id, e.chunk_id FROM expected e LEFT JOIN blocks b USING (file, prompt_id, chunk_id) WHERE b.code IS NULL""")
def reply_missing_chunks(spark, sf_dir):
    return replies.expected_vs_returned(_expected(spark, sf_dir), replies.batched_blocks(_blocks(spark, sf_dir)))[1]


def _patches(spark, sf_dir):
    """Ranges per document: one good, one inside it, one after, one out of bounds."""
    n = F.col("doc_id")
    span = lambda a, b, code: F.struct(F.lit(a).alias("start_line"), F.lit(b).alias("end_line"), F.lit(code).alias("code"))
    spans = F.array(span(2, 3, "new a\n  new b"), span(3, 3, "inner"), span(5, 5, "x\ny\nz"), span(90000, 90001, "off"))
    return read(spark, sf_dir, "documents").select(n.alias("file"), F.posexplode(spans).alias("emit", "p")).select("file", "emit", "p.*")


def _spliced(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id").select(F.col("doc_id").alias("file"), F.concat(F.lit("# head\n  "), "text").alias("content"))
    kept = chunks.drop_nested(_patches(spark, sf_dir), ["emit"])
    return replies.splice(docs, kept)


@query("splice_lines", """
WITH t AS (SELECT doc_id, string_split('# head' || chr(10) || '  ' || text, chr(10)) AS l FROM documents),
p AS (SELECT doc_id, l, len(l) AS n FROM t),
edited AS (
  SELECT doc_id, n,
    array_to_string(list_concat(list_concat(list_concat(l[1:1],
      CASE WHEN n >= 3 THEN ['  new a', '  new b'] ELSE l[2:3] END),
      CASE WHEN n >= 5 THEN list_concat(l[4:4], ['x', 'y', 'z']) ELSE l[4:5] END), l[6:n]), chr(10)) AS body
  FROM p)
SELECT doc_id AS file, body || CASE WHEN n = 3 OR n = 5 THEN chr(10) ELSE '' END AS content,
  CAST((n >= 3)::INT + (n >= 5)::INT AS INT) AS applied FROM edited""")
def splice_lines(spark, sf_dir):
    return _spliced(spark, sf_dir)[0]


@query("splice_rejects", """
WITH n AS (SELECT doc_id, len(string_split('# head' || chr(10) || '  ' || text, chr(10))) AS n FROM documents),
bad AS (
  SELECT doc_id, n, 90000 AS s, 90001 AS e FROM n
  UNION ALL SELECT doc_id, n, 2, 3 FROM n WHERE n < 3 UNION ALL SELECT doc_id, n, 5, 5 FROM n WHERE n < 5)
SELECT doc_id AS file, 'Invalid line range [' || s || ', ' || e || '] for file with ' || n || ' lines.' AS reason FROM bad""")
def splice_rejects(spark, sf_dir):
    return _spliced(spark, sf_dir)[1].select("file", "reason")


@query("retry_waits", r"""
WITH RECURSIVE ranked AS (
  SELECT event_id // 10 AS user_id, event_type, row_number() OVER (PARTITION BY event_id // 10 ORDER BY ts) AS attempt,
         CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS k FROM events),
walk AS (
  SELECT user_id, attempt, CASE WHEN event_type = 'signup' THEN NULL WHEN event_type = 'error' THEN k + 2 WHEN event_type = 'purchase' THEN 20 ELSE 5 END AS wait,
         CASE WHEN event_type = 'signup' THEN 5 ELSE greatest(10, CASE WHEN event_type = 'error' THEN k + 2 WHEN event_type = 'purchase' THEN 20 ELSE 5 END // 2) END AS base,
         event_type = 'signup' AS fatal
  FROM ranked WHERE attempt = 1
  UNION ALL
  SELECT r.user_id, r.attempt,
    CASE WHEN r.event_type = 'signup' THEN NULL WHEN r.event_type = 'error' THEN r.k + 2 WHEN r.event_type = 'purchase' THEN w.base + 15 ELSE w.base END,
    greatest(2 * w.base, CASE WHEN r.event_type = 'signup' THEN 0 WHEN r.event_type = 'error' THEN r.k + 2 WHEN r.event_type = 'purchase' THEN w.base + 15 ELSE w.base END // 2),
    r.event_type = 'signup'
  FROM walk w JOIN ranked r ON r.user_id = w.user_id AND r.attempt = w.attempt + 1
  WHERE NOT w.fatal AND w.attempt < 10)
SELECT user_id AS request_id, CASE WHEN bool_or(fatal) THEN 'fatal' WHEN count(wait) >= 10 THEN 'exhausted' ELSE 'waiting' END AS outcome,
  coalesce(string_agg(wait, ',' ORDER BY attempt) FILTER (wait IS NOT NULL), '') AS waits, CAST(coalesce(sum(wait), 0) AS BIGINT) AS total_wait_s
FROM walk GROUP BY 1""")
def retry_waits(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"(\d+)", 1)
    kind = F.col("event_type")
    message = (
        F.when(kind == "error", F.concat(F.lit("429 Too many: 'retryDelay': '"), k, F.lit("s'")))
        .when(kind == "click", F.lit("503 unavailable")).when(kind == "view", F.lit("HTTP 429"))
        .when(kind == "purchase", F.lit("Quota exceeded")).otherwise(F.lit("invalid argument"))
    )
    # ten attempts each, so every row counts
    attempts = events.select(F.floor(F.col("event_id") / 10).alias("request_id"), "ts", message.alias("message"))
    waits = replies.retry_waits(attempts)
    return waits.withColumn("waits", F.array_join(F.col("waits").cast("array<string>"), ","))


@query("send_schedule", """
SELECT conv_id AS file, turn AS prompt_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS send_no,
  (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) * 2.0::DOUBLE AS send_offset_s
FROM conversations""")
def send_schedule(spark, sf_dir):
    sent = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("prompt_id"))
    return replies.send_schedule(sent, [F.col("prompt_id")])
