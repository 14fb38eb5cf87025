"""Queries over chunk tables: numbering, containment, batches, envelopes, units of code."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom import schemas
from patchloom.operators import brace, chunks, python_units, structure
from patchloom.plans import block_samples, derive
from patchloom.plans.registry import query, read
from patchloom.skew import heavy_keys, scan_within
from patchloom.sources import envelopes

SPANS = """
spans AS (
  SELECT l_orderkey AS file, CAST(1 + l_partkey % 40 AS INT) AS start_line, CAST(1 + l_partkey % 40 + l_suppkey % 12 AS INT) AS end_line,
         l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS emit
  FROM lineitem),
numbered AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY start_line, emit) AS chunk_no FROM spans)"""


def _heavy(spark, sf_dir):
    return heavy_keys(derive.intervals(spark, sf_dir), "file")


def _numbered(spark, sf_dir, heavy=None):
    return chunks.renumber(derive.intervals(spark, sf_dir), derive.LINE_KEY, heavy)


@query("chunk_renumber", f"""
WITH {SPANS}
SELECT file, start_line, end_line, chunk_no, 'chunk_' || chunk_no AS chunk_id FROM numbered""")
def chunk_renumber(spark, sf_dir):
    return _numbered(spark, sf_dir).select("file", "start_line", "end_line", "chunk_no", "chunk_id")


@query("chunk_counts", """
SELECT o_orderkey AS file, coalesce(n, 0) AS total_chunks
FROM (SELECT DISTINCT o_orderkey FROM orders) o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey""")
def chunk_counts(spark, sf_dir):
    files = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file")).distinct()
    return chunks.count_per_file(files, derive.intervals(spark, sf_dir), "total_chunks")


@query("chunk_containment", f"""
WITH {SPANS}
SELECT file, start_line, end_line, emit FROM spans a
WHERE NOT EXISTS (
  SELECT 1 FROM spans b WHERE b.file = a.file AND b.start_line <= a.start_line AND b.end_line >= a.end_line
    AND (b.start_line < a.start_line OR b.end_line > a.end_line OR b.emit < a.emit))""")
def chunk_containment(spark, sf_dir):
    heavy = _heavy(spark, sf_dir)
    spans = scan_within(
        derive.intervals(spark, sf_dir), ["file"], [F.col(c) for c in derive.LINE_KEY], rank="emit", heavy=heavy
    )
    return chunks.drop_nested(spans, ["emit"], heavy).select("file", "start_line", "end_line", "emit")


PROMPTS = SPANS + """,
flat AS (SELECT file, (chunk_no - 1) // 3 AS prompt_id, chunk_no, start_line, end_line FROM numbered),
bad AS (
  SELECT DISTINCT a.file, a.prompt_id FROM flat a JOIN flat b ON a.file = b.file AND a.prompt_id <> b.prompt_id
    AND b.start_line <= a.start_line AND b.end_line >= a.end_line
    AND (b.start_line < a.start_line OR b.end_line > a.end_line OR b.prompt_id < a.prompt_id))"""
ITEM = ["chunk_id", "start_line", "end_line"]


@query("prompt_containment", f"""
WITH {PROMPTS}
SELECT f.file, f.prompt_id, CAST(min(start_line) AS INT) AS first_line, count(*) AS chunks
FROM flat f WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.file = f.file AND b.prompt_id = f.prompt_id) GROUP BY 1, 2""")
def prompt_containment(spark, sf_dir):
    heavy = _heavy(spark, sf_dir)
    rows = _numbered(spark, sf_dir, heavy).select(
        "file", F.floor((F.col("chunk_no") - 1) / 3).alias("prompt_id"), "start_line", "end_line")
    kept = chunks.flag_nested_prompts(rows, heavy).filter("NOT prompt_nested")
    return kept.groupBy("file", "prompt_id").agg(
        F.min("start_line").alias("first_line"), F.count(F.lit(1)).alias("chunks"))


@query("prompt_batches", f"""
WITH {PROMPTS}
SELECT file, prompt_id, true AS is_batch, string_agg('chunk_' || chunk_no, ',' ORDER BY chunk_no) AS chunk_ids,
       string_agg(start_line || '-' || end_line, ',' ORDER BY chunk_no) AS ranges
FROM flat GROUP BY 1, 2""")
def prompt_batches(spark, sf_dir):
    prompts = chunks.batch(_numbered(spark, sf_dir), 3, ITEM)
    ranges = F.transform("chunks", lambda c: F.concat(c["start_line"].cast("string"), F.lit("-"), c["end_line"].cast("string")))
    return prompts.select(
        "file", "prompt_id", "is_batch", F.array_join("chunk_ids", ",").alias("chunk_ids"), F.array_join(ranges, ",").alias("ranges")
    )


@query("chunk_envelopes", f"""
WITH {SPANS},
parts AS (SELECT file, CAST((chunk_no - 1) // 4 AS INT) AS part, count(*) AS n, string_agg('chunk_' || chunk_no, ',' ORDER BY chunk_no) AS ids FROM numbered GROUP BY 1, 2)
SELECT CAST(file AS VARCHAR) AS file_name, 'python' AS language, part, n, ids, sum(n) OVER (PARTITION BY file)::BIGINT AS total_chunks FROM parts""")
def chunk_envelopes(spark, sf_dir):
    heavy = _heavy(spark, sf_dir)
    rows = _numbered(spark, sf_dir, heavy).select(
        F.col("file").cast("string").alias("file"), F.lit("python").alias("language"), "chunk_no", "chunk_id",
        F.lit("function").alias("type"), F.lit(None).cast("string").alias("name"), "start_line", "end_line",
        F.lit("").alias("code"), F.lit(None).cast("map<string,string>").alias("metadata"),
    )
    packed = envelopes.chunk_envelopes(rows, part_rows=4)
    # through JSON text and back: what is written is what is read
    texts = packed.select(F.to_json(F.struct(*packed.columns)).alias("value"), "total_chunks", "part")
    rows, _ = envelopes.parse_chunk_envelopes(texts, "value", keep=["part", "total_chunks"])
    return rows.groupBy(F.col("file").alias("file_name"), "language", "part", "total_chunks").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.sort_array(F.collect_list(
            F.struct(F.substring("chunk_id", 7, 20).cast("long").alias("n"), "chunk_id"))), lambda x: x["chunk_id"]), ",").alias("ids"),
    )


@query("prompt_envelopes", f"""
WITH {PROMPTS},
made AS (SELECT file, prompt_id, count(*) AS n, string_agg('chunk_' || chunk_no, '+' ORDER BY chunk_no) AS ids FROM flat GROUP BY 1, 2)
SELECT CAST(file AS VARCHAR) AS file_name, 'python' AS language, CAST(prompt_id // 2 AS INT) AS part, count(*) AS prompts, CAST(sum(n) AS BIGINT) AS chunks,
  string_agg('prompt for ' || ids, ',' ORDER BY prompt_id) AS texts, sum(count(*)) OVER (PARTITION BY file)::BIGINT AS total_prompts
FROM made GROUP BY file, prompt_id // 2""")
def prompt_envelopes(spark, sf_dir):
    heavy = _heavy(spark, sf_dir)
    rows = _numbered(spark, sf_dir, heavy).select(
        F.col("file").cast("string").alias("file"), F.lit("python").alias("language"), "chunk_no", "chunk_id",
        F.lit("function").alias("type"), F.lit(None).cast("string").alias("name"), "start_line", "end_line",
        F.lit("").alias("code"), F.lit(None).cast("map<string,string>").alias("metadata"))
    item = ["chunk_id", "type", "name", "start_line", "end_line", "code", "metadata"]
    prompts = chunks.batch(rows, 3, item, carry=["language"]).withColumn(
        "prompt", F.concat(F.lit("prompt for "), F.array_join("chunk_ids", "+")))
    packed = envelopes.prompt_envelopes(prompts, part_rows=2)
    # through JSON text and back, as the next stage reads it
    documents = packed.select(F.from_json(F.to_json(F.struct(*packed.columns)), schemas.PROMPT_ENVELOPE).alias("d"))
    sizes = F.transform("d.prompts", lambda p: F.size(p["chunks"]).cast("long"))
    return documents.select(
        "d.file_name", "d.language", "d.part", F.size("d.prompts").cast("long").alias("prompts"),
        F.aggregate(sizes, F.lit(0).cast("long"), lambda a, n: a + n).alias("chunks"),
        F.array_join("d.prompts.prompt", ",").alias("texts"), "d.total_prompts")


@query("envelope_rejects", """
SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'missing key: file_name' WHEN 2 THEN 'missing key: chunks'
  WHEN 3 THEN '''chunks'' must be an array' WHEN 4 THEN 'not JSON' END AS reject_reason
FROM documents WHERE doc_id % 5 <> 0""")
def envelope_rejects(spark, sf_dir):
    n = F.col("doc_id") % 5
    code = F.struct(F.lit("chunk_1").alias("chunk_id"), F.col("text").alias("code"))
    full = F.to_json(F.struct(F.lit("a.py").alias("file_name"), F.lit("python").alias("language"), F.array(code).alias("chunks")))
    value = (
        F.when(n == 0, full)
        .when(n == 1, F.to_json(F.struct(F.lit("python").alias("language"), F.array(code).alias("chunks"))))
        .when(n == 2, F.to_json(F.struct(F.lit("a.py").alias("file_name"), F.lit("python").alias("language"))))
        .when(n == 3, F.to_json(F.struct(F.lit("a.py").alias("file_name"), F.lit("python").alias("language"), code.alias("chunks"))))
        .otherwise(F.concat(F.lit("{"), F.col("text")))
    )
    docs = read(spark, sf_dir, "documents").select("doc_id", value.alias("value"))
    _, rejects = envelopes.parse_chunk_envelopes(docs, "value", keep=["doc_id"])
    return rejects.select("doc_id", "reject_reason")


LAYOUT = """layout AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)"""


@query("brace_units", f"""
WITH {LAYOUT},
units AS (
  SELECT doc_id, 'function' AS type, 'f' || doc_id AS name, 1 AS start_line, 5 + n AS end_line FROM layout
  UNION ALL SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'class' ELSE 'struct' END, 'K' || doc_id, 8 + n, 11 + n FROM layout)
SELECT 'b/d' || doc_id AS file, CASE doc_id % 3 WHEN 0 THEN 'javascript' WHEN 1 THEN 'go' ELSE 'c' END AS language,
       type, name, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line FROM units""")
def brace_units(spark, sf_dir):
    return brace.brace_units(derive.brace_files(spark, sf_dir))


@query("block_units", f"""
WITH {block_samples.EXPECTED}
SELECT file, language, type, name, start_line, end_line FROM expected WHERE NOT nested""")
def block_units(spark, sf_dir):
    return brace.brace_units(block_samples.files(spark, sf_dir))


@query("block_units_nested", f"""
WITH {block_samples.EXPECTED}
SELECT file, language, type, name, start_line, end_line FROM expected""")
def block_units_nested(spark, sf_dir):
    return brace.brace_units(block_samples.files(spark, sf_dir), nested=True)


@query("block_balance", f"""
WITH {block_samples.EXPECTED}
SELECT file, language, true AS even FROM (SELECT DISTINCT file, language FROM expected)""")
def block_balance(spark, sf_dir):
    marks = brace.block_balance(block_samples.files(spark, sf_dir))
    return marks.select("file", "language", ((F.col("opens") == F.col("closes")) & (F.col("unclosed") == 0)).alias("even"))


@query("brace_unit_code", """
WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT 'b/d' || doc_id AS file, 'f' || doc_id AS name,
  CASE doc_id % 3 WHEN 0 THEN 'function f' || doc_id || '(a) {' WHEN 1 THEN 'func f' || doc_id || '(a int) {' ELSE 'int f' || doc_id || '(int a) {' END
  || chr(10) || '  if (a) {' || chr(10) || '    s = "}";  // }' || chr(10) || '  }' || chr(10)
  || array_to_string(list_transform(l, lambda x: '  // { ' || x), chr(10)) || chr(10) || '}' AS code
FROM lines
UNION ALL
SELECT 'b/d' || doc_id, 'K' || doc_id,
  CASE doc_id % 3 WHEN 0 THEN 'class K' || doc_id || ' {' WHEN 1 THEN 'type K' || doc_id || ' struct {' ELSE 'struct K' || doc_id || ' {' END
  || chr(10) || '  m(a) {' || chr(10) || '  }' || chr(10) || '}'
FROM lines""")
def brace_unit_code(spark, sf_dir):
    files = derive.brace_files(spark, sf_dir)
    coded = chunks.with_code(brace.brace_units(files), files)
    return coded.select("file", "name", "code")


@query("python_units", f"""
WITH {LAYOUT},
good AS (SELECT * FROM layout WHERE doc_id % 9 <> 0),
units AS (
  SELECT doc_id, 'class' AS type, 'C' || doc_id AS name, NULL AS parent, 1 AS start_line, 3 AS end_line, NULL AS positional_args, NULL AS has_varargs, 1 AS method_count, 1 AS base_count FROM good
  UNION ALL SELECT doc_id, 'method', 'm', 'C' || doc_id, 2, 3, 2, false, NULL, NULL FROM good
  UNION ALL SELECT doc_id, 'function', 'f' || doc_id, NULL, 6, 8 + n, 2, true, NULL, NULL FROM good)
SELECT 'p/d' || doc_id || '.py' AS file, type, name, parent, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line,
  CAST(positional_args AS INT) AS positional_args, has_varargs, CAST(method_count AS INT) AS method_count, CAST(base_count AS INT) AS base_count,
  'chunk_' || row_number() OVER (PARTITION BY doc_id ORDER BY start_line) AS chunk_id
FROM units""")
def python_units_query(spark, sf_dir):
    units = python_units.units(python_units.parse(derive.python_files(spark, sf_dir)))
    return chunks.renumber(units, ["emit"]).select(
        "file", "type", "name", "parent", "start_line", "end_line", "positional_args", "has_varargs", "method_count", "base_count", "chunk_id"
    )


@query("python_units_varied", f"""
WITH {block_samples.expected(block_samples.PYTHON, "v/d")}
SELECT file, type, name, parent, start_line, end_line FROM expected""")
def python_units_varied(spark, sf_dir):
    files = block_samples.files(spark, sf_dir, block_samples.PYTHON, "v/d")
    return python_units.units(python_units.parse(files)).select("file", "type", "name", "parent", "start_line", "end_line")


@query("syntax_check", """
SELECT 'p/d' || doc_id || '.py' AS file, doc_id % 9 <> 0 AS ok,
  CASE WHEN doc_id % 9 <> 0 THEN 'Syntax OK'
       ELSE 'SyntaxError at line 7, col ' || (length(CAST(doc_id AS VARCHAR)) + 21) || ': expected '':''' END AS message
FROM documents""")
def syntax_check(spark, sf_dir):
    return python_units.syntax_status(python_units.parse(derive.python_files(spark, sf_dir)))


@query("public_functions", """
SELECT 'p/d' || doc_id || '.py' AS file, 'f' || doc_id AS name FROM documents WHERE doc_id % 9 <> 0""")
def public_functions(spark, sf_dir):
    parsed = python_units.parse(derive.python_files(spark, sf_dir))
    return python_units.public_functions(python_units.units(parsed)).select("file", "name")


STRUCTURE = """
base AS (
  SELECT l_orderkey AS file, CASE WHEN l_returnflag = 'A' THEN 'class' ELSE 'function' END AS kind, l_linenumber, l_partkey AS ord,
    l_orderkey % 4 AS how, CAST(l_quantity % 5 AS INT) AS args, l_linestatus = 'O' AS va, l_suppkey % 2 = 0 AS kw, CAST(l_partkey % 4 AS INT) AS methods
  FROM lineitem),
sides AS (
  SELECT file, kind, 'f' || l_linenumber AS name, ord, args, va, kw, methods, 'o' AS side FROM base
  UNION ALL
  SELECT file, kind, CASE WHEN how = 3 AND l_linenumber = 1 THEN 'g1' ELSE 'f' || l_linenumber END, ord,
    args + CASE WHEN how = 2 THEN 1 ELSE 0 END, va, kw, methods, 'r' FROM base WHERE NOT (how = 1 AND l_linenumber = 1)),
last AS (
  SELECT *, min(ord) OVER (PARTITION BY file, kind, name, side) AS place FROM sides
  QUALIFY row_number() OVER (PARTITION BY file, kind, name, side ORDER BY ord DESC, args DESC, va DESC, kw DESC, methods DESC) = 1),
counts AS (SELECT file, kind, count(*) FILTER (side = 'o') AS o, count(*) FILTER (side = 'r') AS r FROM last GROUP BY 1, 2),
pairs AS (
  SELECT o.file, o.kind, o.name, o.place, o.args AS oa, r.args AS ra, o.va AS ov, r.va AS rv, o.kw AS ok_, r.kw AS rk, o.methods AS om, r.methods AS rm, r.name IS NULL AS gone
  FROM (SELECT * FROM last WHERE side = 'o') o LEFT JOIN (SELECT * FROM last WHERE side = 'r') r ON o.file = r.file AND o.kind = r.kind AND o.name = r.name),
msgs AS (
  SELECT file, kind, place, name, 0 AS k, CASE kind WHEN 'function' THEN 'Function ''' ELSE 'Class ''' END || name || ''' missing in refactored code' AS m FROM pairs WHERE gone
  UNION ALL SELECT file, kind, place, name, 1, 'Function ''' || name || ''': positional arg count changed ' || oa || ' → ' || ra FROM pairs WHERE kind = 'function' AND oa <> ra
  UNION ALL SELECT file, kind, place, name, 2, 'Function ''' || name || ''': *args presence changed ' || CASE WHEN ov THEN 'True' ELSE 'False' END || ' → ' || CASE WHEN rv THEN 'True' ELSE 'False' END FROM pairs WHERE kind = 'function' AND ov <> rv
  UNION ALL SELECT file, kind, place, name, 3, 'Function ''' || name || ''': **kwargs presence changed ' || CASE WHEN ok_ THEN 'True' ELSE 'False' END || ' → ' || CASE WHEN rk THEN 'True' ELSE 'False' END FROM pairs WHERE kind = 'function' AND ok_ <> rk
  UNION ALL SELECT file, kind, place, name, 4, 'Class ''' || name || ''': method count changed ' || om || ' → ' || rm FROM pairs WHERE kind = 'class' AND om <> rm),
issues AS (
  SELECT file, kind, -1 AS place, '' AS name, 0 AS k, 'Top-level ' || kind || ' count changed: ' || o || ' → ' || r AS m FROM counts WHERE o <> r
  UNION ALL SELECT msgs.* FROM msgs JOIN counts c ON msgs.file = c.file AND msgs.kind = c.kind AND c.o = c.r),
joined AS (SELECT file, count(*) AS n, string_agg(m, '; ' ORDER BY kind DESC, place, name, k) AS message FROM issues GROUP BY 1)"""


@query("structure_compare", f"""
WITH {STRUCTURE}
SELECT f.file, n IS NULL AS ok, coalesce(message, 'AST structure preserved') AS message, CAST(coalesce(n, 0) AS INT) AS n_issues
FROM (SELECT DISTINCT file FROM sides) f LEFT JOIN joined j ON j.file = f.file""")
def structure_compare(spark, sf_dir):
    return structure.compare(derive.structure_units(spark, sf_dir))


@query("class_methods", """
SELECT 'p/d' || doc_id || '.py' AS file, 'C' || doc_id AS name, 1 AS method_count FROM documents WHERE doc_id % 9 <> 0""")
def class_methods(spark, sf_dir):
    parsed = python_units.parse(derive.python_files(spark, sf_dir))
    return python_units.class_method_counts(python_units.units(parsed))


@query("open_literals", """
SELECT 'b/d' || doc_id AS file, doc_id % 5 = 0 AS open_literal FROM documents""")
def open_literals(spark, sf_dir):
    files = derive.brace_files(spark, sf_dir)
    cut_off = F.concat("content", F.when(F.col("doc_id") % 5 == 0, F.lit('s = "open {\n')).otherwise(F.lit("")))
    return brace.open_literals(files.withColumn("content", cut_off))
