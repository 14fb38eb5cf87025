"""Queries over prompts: lookups, rendering, examples, retry context."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom import config
from patchloom.functions.text import bullets
from patchloom.operators import chunks, prompts, replies
from patchloom.plans import derive
from patchloom.plans.registry import query, read

TYPES = ["function", "class", "method", "interface", "async_method", "constructor", "widget"]
LANGUAGES = ["python", "Go", "java", "rust"]
EXAMPLES = [
    ("e1", "python", "function", "d", "def a(): pass", "def b(): pass", "n1", 0),
    ("e2", "Python", "Function", "d", "never", "never", "second of its key", 1),
    ("e3", "*", "class", "d", "class A: pass", "class B: pass", None, 2),
    ("e4", "go", "*", "d", "func a() {}", "func b() {}", "n4", 3),
    ("e5", "go", "class", "d", "x", "y", "n5", 4),
]
EXAMPLE_SCHEMA = (
    "id STRING, language STRING, chunk_type STRING, description STRING, before STRING, after STRING, notes STRING, position INT"
)


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _examples(spark):
    return config.table(spark, EXAMPLES, EXAMPLE_SCHEMA)


def _document_chunks(spark, sf_dir):
    """Every document cut into chunks of four lines or more, with type, language and parent by id.

    Longer documents have longer chunks, so a document has some ten chunks at most.
    """
    docs = read(spark, sf_dir, "documents", "doc_id")
    n = F.col("doc_id")
    lines = docs.select(n, F.split("text", "\n").alias("lines")).withColumn("step", F.floor(F.size("lines") / 10).cast("int") + 4)
    starts = F.sequence(F.lit(1), F.size("lines"), F.col("step"))
    cut = lines.select("doc_id", "lines", "step", F.posexplode(starts).alias("at", "start_line"))
    kind = (n + F.col("at")) % 7
    last = F.least(F.col("start_line") + F.col("step") - 1, F.size("lines"))
    return cut.select(
        F.concat(F.lit("src/d"), n.cast("string")).alias("file"), n, (F.col("at") + 1).cast("long").alias("chunk_no"),
        derive._pick(n % 4, LANGUAGES).alias("language"), derive._pick(kind, TYPES).alias("type"),
        F.concat(F.lit("chunk_"), (F.col("at") + 1).cast("string")).alias("chunk_id"),
        F.when(n % 6 != 0, F.concat(F.lit("n"), n.cast("string"))).alias("name"), "start_line", last.alias("end_line"),
        F.array_join(F.slice("lines", F.col("start_line"), F.col("step")), "\n").alias("code"),
        F.when(kind == 1, F.create_map(F.lit("parent_class"), F.lit("Outer"))).alias("metadata"),
    )


def _document_texts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("src/d"), F.col("doc_id").cast("string")).alias("file"), F.col("text").alias("content"))


ROWS = f"""
texts AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l, len(string_split(text, chr(10))) // 10 + 4 AS step FROM documents),
cuts AS (SELECT *, unnest(range(0, CAST(ceil(len(l) / step) AS BIGINT))) AS nth FROM texts),
rows AS (
  SELECT doc_id, nth + 1 AS chunk_no, 'src/d' || doc_id AS file, {_sql_list(LANGUAGES)}[1 + doc_id % 4] AS language,
    {_sql_list(TYPES)}[1 + (doc_id + nth) % 7] AS type, 'chunk_' || (nth + 1) AS chunk_id,
    CASE WHEN doc_id % 6 <> 0 THEN 'n' || doc_id END AS name, nth * step + 1 AS start_line, least(nth * step + step, len(l)) AS end_line,
    array_to_string(list_slice(l, nth * step + 1, nth * step + step), chr(10)) AS code,
    CASE WHEN text <> '' THEN text ELSE 'Not provided.' END AS file_content,
    CASE WHEN (doc_id + nth) % 7 = 1 THEN 'Outer' END AS parent
  FROM cuts),
hits AS (
  SELECT *, CASE
      WHEN lower(language) = 'python' AND type = 'function' THEN 'e1'
      WHEN lower(language) = 'go' AND type = 'class' THEN 'e5'
      WHEN type = 'class' THEN 'e3'
      WHEN lower(language) = 'go' THEN 'e4' END AS example_id
  FROM rows)"""


@query("fewshot_lookup", f"WITH {ROWS} SELECT file, chunk_id, language, type, example_id FROM hits")
def fewshot_lookup(spark, sf_dir):
    rows = _document_chunks(spark, sf_dir).select("file", "chunk_id", "language", "type")
    return prompts.attach_example(rows, _examples(spark)).select("file", "chunk_id", "language", "type", F.col("example.id").alias("example_id"))


@query("template_resolve", f"""
WITH {ROWS}
SELECT file, chunk_id, CASE WHEN lower(language) = 'rust' AND type = 'method' THEN 'special'
  WHEN lower(language) = 'java' THEN 'plain' WHEN type = 'class' THEN 'class' WHEN type = 'interface' THEN 'interface' ELSE 'standard' END AS template
FROM rows""")
def template_resolve(spark, sf_dir):
    from patchloom.operators.languages import with_overrides

    extra = config.table(spark, [("rust", "method", "special", 1), ("java", "*", "plain", 2)], "language STRING, chunk_type STRING, template STRING, seq INT")
    keys = with_overrides(config.template_keys(spark), extra, ["language", "chunk_type"])
    rows = _document_chunks(spark, sf_dir).select("file", "chunk_id", "language", "type")
    return prompts.attach_template(rows, keys).select("file", "chunk_id", "template")


def _case(column: str, pairs: list[tuple], render, default: str) -> str:
    whens = " ".join(f"WHEN {_sql_text(k)} THEN {_sql_text(render(v))}" for k, v in pairs)
    return f"CASE {column} {whens} ELSE {_sql_text(default)} END"


_bul = lambda items: "\n".join("- " + x for x in items)
GOALS_SQL = _case("type", config.GOALS_BY_TYPE, _bul, _bul(config.GOALS_DEFAULT))
CONSTRAINTS_SQL = _case(
    "type", config.CONSTRAINTS_BY_TYPE, lambda v: _bul(config.CONSTRAINTS_COMMON + v), _bul(config.CONSTRAINTS_COMMON)
)
STYLE_SQL = _case("language", config.STYLE_BY_LANGUAGE, lambda v: v, config.STYLE_DEFAULT)


@query("guidance_lookup", f"WITH {ROWS} SELECT file, chunk_id, {GOALS_SQL} AS goals, {CONSTRAINTS_SQL} AS constraints, {STYLE_SQL} AS style_note FROM rows")
def guidance_lookup(spark, sf_dir):
    rows = prompts.attach_guidance(_document_chunks(spark, sf_dir).select("file", "chunk_id", "language", "type"))
    return rows.select("file", "chunk_id", bullets(F.col("goals")).alias("goals"), bullets(F.col("constraints")).alias("constraints"), "style_note")


def _replace_chain(template: str, fields: list[tuple[str, str]]) -> str:
    sql = _sql_text(template)
    for name, value in fields:
        sql = f"replace({sql}, '{{{name}}}', {value})"
    return sql


def _example_sql(scope: str) -> str:
    cases = []
    for e in EXAMPLES:
        text = _replace_chain(prompts.EXAMPLE, [
            ("example_scope", _sql_text(scope)), ("language", "language"), ("before", _sql_text(e[4])),
            ("after", _sql_text(e[5])), ("notes", _sql_text(e[6] or "")),
        ])
        cases.append(f"WHEN '{e[0]}' THEN {text}")
    return f"CASE example_id {' '.join(cases)} ELSE '' END"


LINES = "'lines ' || start_line || '–' || end_line"
SHOWN = "coalesce(name, '<anonymous ' || type || '>')"
FIELDS = [
    ("goals", GOALS_SQL), ("constraints", CONSTRAINTS_SQL), ("style_note", STYLE_SQL), ("file_name", "file"),
    ("language", "language"), ("chunk_id", "chunk_id"), ("type", "type"), ("display_name", SHOWN),
    ("line_range", LINES), ("context_line", "CASE WHEN parent IS NOT NULL THEN chr(10) || 'Context: This ' || type || ' is defined inside the `' || parent || '` class.' || chr(10) ELSE '' END"),
    ("code", "code"), ("file_content", "file_content"),
]


@query("prompt_render", f"""
WITH {ROWS}
SELECT file, chunk_id, CASE type WHEN 'class' THEN {_replace_chain(prompts.CLASS, FIELDS)}
  WHEN 'interface' THEN {_replace_chain(prompts.INTERFACE, FIELDS)}
  ELSE {_replace_chain(prompts.STANDARD, FIELDS)} END || {_example_sql("")} AS prompt
FROM hits""")
def prompt_render(spark, sf_dir):
    rows = prompts.attach_guidance(_document_chunks(spark, sf_dir))
    rows = prompts.attach_example(prompts.attach_template(rows), _examples(spark))
    # the text joins last, so it is shuffled once per prompt and never through the lookups
    rows = prompts.attach_context(rows, _document_texts(spark, sf_dir))
    return prompts.single_prompt(rows).select("file", "chunk_id", "prompt")


def _batched(spark, sf_dir):
    """Two chunks at a time in one prompt; the first gives the type."""
    item = ["chunk_id", "type", "name", "start_line", "end_line", "code", "metadata"]
    grouped = chunks.batch(_document_chunks(spark, sf_dir), 2, item, carry=["language"])
    return grouped.withColumn("type", F.get("chunks", F.lit(0))["type"])


HEAD_FIELDS = [("file_name", "file"), ("language", "language"), ("n_chunks", "n"), ("style_note", STYLE_SQL), ("file_content", "file_content")]
CHUNK_SQL = _replace_chain(prompts.BATCH_CHUNK, [
    ("chunk_id", "chunk_id"), ("type", "type"), ("display_name", SHOWN), ("line_range", LINES), ("language", "language"), ("code", "code")])
BATCHES = f"""batches AS (
  SELECT file, (chunk_no - 1) // 2 AS prompt_id, language, file_content, CAST(count(*) AS VARCHAR) AS n,
    arg_min(example_id, chunk_no) FILTER (true) AS first_example, bool_or(chunk_no % 2 = 1 AND example_id IS NULL) AS none,
    string_agg({CHUNK_SQL}, chr(10) || chr(10) ORDER BY chunk_no) AS body
  FROM hits GROUP BY ALL),
filled AS (SELECT *, CASE WHEN none THEN NULL ELSE first_example END AS example_id FROM batches)"""
BATCH_SQL = (
    f"{_replace_chain(prompts.BATCH_HEAD, HEAD_FIELDS)} || body || "
    f"{_replace_chain(prompts.BATCH_TAIL, HEAD_FIELDS)} || {_example_sql(' for single chunks')}"
)


def _batch_prompts(spark, sf_dir):
    rows = prompts.attach_example(prompts.attach_guidance(_batched(spark, sf_dir)), _examples(spark))
    rows = prompts.attach_context(rows, _document_texts(spark, sf_dir))
    return prompts.batch_prompt(rows)


@query("prompt_render_batch", f"WITH {ROWS}, {BATCHES} SELECT file, prompt_id, {BATCH_SQL} AS prompt FROM filled")
def prompt_render_batch(spark, sf_dir):
    return _batch_prompts(spark, sf_dir).select("file", "prompt_id", "prompt")


@query("prompt_order", f"""
WITH {ROWS} SELECT file, (chunk_no - 1) // 2 AS prompt_id, CAST(min(start_line) AS INT) AS first_line FROM rows GROUP BY 1, 2""")
def prompt_order(spark, sf_dir):
    return chunks.application_order(_batched(spark, sf_dir)).select("file", "prompt_id", "first_line")


@query("prompt_sizes", f"""
WITH {ROWS}, {BATCHES}, made AS (SELECT file, length({BATCH_SQL}) AS n FROM filled)
SELECT file, count(*) AS prompts, CAST(sum(n) AS BIGINT) AS chars, CAST(max(n) AS INT) AS longest FROM made GROUP BY 1""")
def prompt_sizes(spark, sf_dir):
    return replies.prompt_sizes(_batch_prompts(spark, sf_dir))


RETRY_FIELDS = [
    ("severity", "CASE WHEN doc_id % 19 = 0 THEN 'ERROR' WHEN bad <> '' THEN 'WARNING' ELSE 'PASS' END"),
    ("failed_block", "CASE WHEN bad = '' THEN '  (see full report below)' ELSE bad END"), ("report_text", "text"),
]


@query("retry_context", f"""
WITH c AS (
  SELECT doc_id, text, rtrim(
      CASE WHEN doc_id % 19 = 0 THEN '  - [syntax] SyntaxError at line 1, col 1: bad' || chr(10) ELSE '' END
      || CASE WHEN n_chars % 3 = 0 THEN '  - [ast_structure] count changed' || chr(10) ELSE '' END
      || CASE WHEN doc_id % 4 = 0 THEN '  - [property:determinism] f' || doc_id || ' — varies' || chr(10) ELSE '' END, chr(10)) AS bad
  FROM documents)
SELECT doc_id AS file, {_replace_chain(prompts.RETRY, RETRY_FIELDS)} || 'Task ' || doc_id AS prompt FROM c""")
def retry_context(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    n = F.col("doc_id")
    check = lambda name, ok, message: F.struct(F.lit(name).alias("check"), ok.alias("passed"), F.lit(message).alias("message"))
    broken = F.when(n % 4 == 0, F.array(F.struct(
        F.concat(F.lit("f"), n.cast("string")).alias("function"), F.lit("determinism").alias("property"), F.lit("varies").alias("message"))))
    bad = (n % 19 == 0) | (F.col("n_chars") % 3 == 0) | (n % 4 == 0)
    reports = docs.select(
        n.alias("file"), F.when(n % 19 == 0, F.lit("error")).when(bad, F.lit("warning")).otherwise(F.lit("pass")).alias("severity"),
        F.array(check("syntax", n % 19 != 0, "SyntaxError at line 1, col 1: bad"), check("ast_structure", F.col("n_chars") % 3 != 0, "count changed")).alias("checks"),
        broken.alias("property_failures"), F.col("text").alias("report_text"),
    )
    tasks = docs.select(n.alias("file"), F.lit(0).alias("prompt_id"), F.concat(F.lit("Task "), n.cast("string")).alias("prompt"))
    return prompts.inject_context(tasks, prompts.retry_context(reports)).select("file", "prompt")
