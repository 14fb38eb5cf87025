"""Queries over texts: lines, diffs, languages, lint, sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom.functions.text import human_size, slice_lines, split_lines
from patchloom.operators import diff, languages, lint
from patchloom.plans import derive
from patchloom.plans.registry import query, read
from patchloom.sources import corpus


@query("lines_exploded", """
SELECT doc_id AS file, CAST(unnest(generate_series(1, len(string_split(text, chr(10))))) AS INT) AS line_no,
       unnest(string_split(text, chr(10))) AS text
FROM documents""")
def lines_exploded(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("content"))
    return corpus.exploded_lines(docs)


@query("line_slices", """
SELECT doc_id AS file, array_to_string(list_slice(string_split(text, chr(10)), 1 + doc_id % 3, 3 + doc_id % 4), chr(10)) AS code
FROM documents""")
def line_slices(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    start, end = (F.col("doc_id") % 3 + 1).cast("int"), (F.col("doc_id") % 4 + 3).cast("int")
    return docs.select(F.col("doc_id").alias("file"), slice_lines(split_lines(F.col("text")), start, end).alias("code"))


PAIRS = """
pairs AS (
  SELECT doc_id AS file, string_split(text, chr(10)) AS a,
         string_split(replace(text, 'the ', 'THE ') || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'extra' ELSE '' END, chr(10)) AS b
  FROM documents WHERE doc_id % 7 <> 0 AND text <> ''),
rows AS (SELECT file, a, b, unnest(generate_series(1, greatest(len(a), len(b)))) AS line FROM pairs),
diff AS (
  SELECT file, CAST(line AS INT) AS line, coalesce(a[line], '') AS original, coalesce(b[line], '') AS refactored,
         coalesce(a[line], '') <> coalesce(b[line], '') AS changed FROM rows)"""


@query("line_diff", f"WITH {PAIRS} SELECT * FROM diff")
def line_diff(spark, sf_dir):
    return diff.line_diff(derive.diff_pairs(spark, sf_dir))


@query("line_diff_counts", f"""
WITH {PAIRS}
SELECT d.doc_id AS file, CAST(count(*) FILTER (changed) AS INT) AS changed_lines, CAST(count(line) AS INT) AS total_lines
FROM documents d LEFT JOIN diff ON diff.file = d.doc_id GROUP BY 1""")
def line_diff_counts(spark, sf_dir):
    return diff.diff_counts(derive.diff_pairs(spark, sf_dir))


@query("unified_diff", f"""
WITH {PAIRS}
SELECT file, line, 0 AS part, CASE WHEN changed THEN '-' ELSE ' ' END AS marker, original AS text FROM diff
UNION ALL SELECT file, line, 1, '+', refactored FROM diff WHERE changed""")
def unified_diff(spark, sf_dir):
    return diff.unified(diff.line_diff(derive.diff_pairs(spark, sf_dir)))


EXTENSION_CASE = (
    "CASE doc_id % 24 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(derive.EXTENSIONS)) + " END"
)
LANGUAGE_CASE = """
CASE lower(ext) WHEN '.py' THEN 'python' WHEN '.pyw' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.mjs' THEN 'javascript'
  WHEN '.cjs' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.java' THEN 'java'
  WHEN '.c' THEN 'c' WHEN '.h' THEN 'c' WHEN '.cpp' THEN 'cpp' WHEN '.cc' THEN 'cpp' WHEN '.cxx' THEN 'cpp' WHEN '.hpp' THEN 'cpp'
  WHEN '.hxx' THEN 'cpp' WHEN '.go' THEN 'go' WHEN '.rs' THEN 'rust' WHEN '.rb' THEN 'ruby' WHEN '.php' THEN 'php'
  WHEN '.swift' THEN 'swift' WHEN '.kt' THEN 'kotlin' WHEN '.kts' THEN 'kotlin' END"""
PATHS = f"""
paths AS (SELECT 'src/' || source || '/d' || doc_id || {EXTENSION_CASE} AS file, doc_id, {EXTENSION_CASE} AS ext FROM documents),
known AS (SELECT file, doc_id, lower(ext) AS ext, {LANGUAGE_CASE} AS language FROM paths)"""


@query("language_detect", f"""
WITH {PATHS}
SELECT file, ext, language, CASE WHEN language = 'python' THEN 'syntax' ELSE 'brace' END AS route
FROM known WHERE language IS NOT NULL AND language NOT IN ('ruby', 'swift', 'kotlin')""")
def language_detect(spark, sf_dir):
    files = derive.document_files(spark, sf_dir).select("file")
    return languages.routed(languages.detect(files))[0].select("file", "ext", "language", "route")


@query("language_rejects", f"""
WITH {PATHS}
SELECT file, CASE WHEN language IS NULL THEN 'Unsupported file extension ''' || ext || ''''
            ELSE 'No parser registered for language ''' || language || '''' END AS reject_reason
FROM known WHERE language IS NULL OR language IN ('ruby', 'swift', 'kotlin')""")
def language_rejects(spark, sf_dir):
    files = derive.document_files(spark, sf_dir).select("file")
    return languages.routed(languages.detect(files))[1].select("file", "reject_reason")


@query("parser_overrides", f"""
WITH {PATHS},
mapped AS (SELECT file, CASE ext WHEN '.h' THEN 'cpp' WHEN '.xyz' THEN 'java' ELSE language END AS language FROM known)
SELECT language, count(*) AS files FROM mapped GROUP BY 1""")
def parser_overrides(spark, sf_dir):
    from patchloom import config

    extra = config.table(spark, [(".h", "c", 1), (".xyz", "java", 2), (".h", "cpp", 3)], "ext STRING, language STRING, seq INT")
    known = languages.with_overrides(config.extensions(spark), extra, ["ext"])
    found = languages.detect(derive.document_files(spark, sf_dir).select("file"), known)
    return found.groupBy("language").agg(F.count(F.lit(1)).alias("files"))


@query("upload_admission", f"""
WITH {PATHS},
names AS (SELECT CASE WHEN doc_id % 10 = 3 THEN '../' || file WHEN doc_id % 10 = 4 THEN file || '.zip' ELSE file END AS file FROM paths)
SELECT file, CASE WHEN file LIKE '../%' THEN 'unsafe path' WHEN NOT (file LIKE '%.py' OR file LIKE '%.zip') THEN 'unsupported type' END AS reject_reason
FROM names""")
def upload_admission(spark, sf_dir):
    files = derive.document_files(spark, sf_dir)
    n = F.col("doc_id") % 10
    name = F.when(n == 3, F.concat(F.lit("../"), "file")).when(n == 4, F.concat("file", F.lit(".zip"))).otherwise(F.col("file"))
    return corpus.admit(files.select(name.alias("file")))


LINT = """
texts AS (
  SELECT doc_id, text || CASE WHEN doc_id % 4 = 1 THEN '  ' WHEN doc_id % 4 = 2 THEN chr(10) || ' ' || chr(10) ELSE '' END
    || CASE WHEN doc_id % 6 = 0 THEN chr(10) || chr(10) || chr(10) || chr(10) || 'def f():' || chr(10) || '    pass' || chr(10) || 'class A:' || chr(10) || '    x = 1' ELSE '' END AS t
  FROM documents),
parts AS (SELECT doc_id, CASE WHEN t[-1] = chr(10) THEN string_split(left(t, len(t) - 1), chr(10)) ELSE string_split(t, chr(10)) END AS l FROM texts),
lines AS (SELECT doc_id AS file, len(l) AS n_lines, unnest(generate_series(1, len(l))) AS no, unnest(l) AS s FROM parts),
marked AS (SELECT *, regexp_full_match(s, '[ \\t]*') AS blank FROM lines),
solid AS (
  SELECT *, lag(no) OVER w AS prev, lag(s) OVER w AS prev_s FROM marked WHERE NOT blank
  WINDOW w AS (PARTITION BY file ORDER BY no)),
gaps AS (
  SELECT *, no - coalesce(prev, 0) - 1 AS gap, regexp_matches(s, '^[^ \\t]') AS top,
    regexp_matches(s, '^(def |class |async def |@)') AS starts,
    coalesce(prev_s LIKE '@%', false) AS after_deco FROM solid),
found AS (
  SELECT file, 'E501' AS rule, no AS line_no, 'line too long (' || length(s) || ' > 120 characters)' AS message FROM marked WHERE length(s) > 120
  UNION ALL SELECT file, 'W293', no, 'blank line contains whitespace' FROM marked WHERE blank AND s <> ''
  UNION ALL SELECT file, 'W291', no, 'trailing whitespace' FROM marked WHERE NOT blank AND regexp_matches(s, '[ \\t]+$')
  UNION ALL SELECT file, 'E303', no, 'too many blank lines (' || gap || ')' FROM gaps WHERE gap > CASE WHEN top THEN 2 ELSE 1 END
  UNION ALL SELECT file, 'E302', no, 'expected 2 blank lines, found ' || gap FROM gaps
    WHERE starts AND prev IS NOT NULL AND NOT after_deco AND gap < 2 AND NOT (coalesce(prev_s LIKE '#%', false) AND gap = 0)
  UNION ALL SELECT file, 'W391', max(no) FILTER (NOT blank) + 1, 'blank line at end of file' FROM marked GROUP BY file, n_lines
    HAVING n_lines > coalesce(max(no) FILTER (NOT blank), 0))"""


def _lint_files(spark, sf_dir):
    n = F.col("doc_id")
    tail = F.when(n % 4 == 1, F.lit("  ")).when(n % 4 == 2, F.lit("\n \n")).otherwise(F.lit(""))
    code = F.when(n % 6 == 0, F.lit("\n\n\n\ndef f():\n    pass\nclass A:\n    x = 1")).otherwise(F.lit(""))
    return read(spark, sf_dir, "documents", "doc_id").select(n.alias("file"), F.concat("text", tail, code).alias("content"))


@query("lint_lines", f"WITH {LINT} SELECT file, rule, CAST(line_no AS INT) AS line_no, message FROM found")
def lint_lines(spark, sf_dir):
    return lint.violations(_lint_files(spark, sf_dir))


@query("lint_stats", f"WITH {LINT} SELECT file, rule, count(*) AS n FROM found GROUP BY ROLLUP (file, rule)")
def lint_stats(spark, sf_dir):
    return lint.statistics(lint.violations(_lint_files(spark, sf_dir)))


@query("lint_check", f"""
WITH {LINT}
SELECT doc_id AS file, count(rule) = 0 AS ok,
  coalesce(string_agg('line ' || line_no || ': ' || rule || ' ' || message, chr(10) ORDER BY line_no, rule), 'No lint issues') AS message
FROM documents LEFT JOIN found ON found.file = doc_id GROUP BY 1""")
def lint_check(spark, sf_dir):
    return lint.lint_check(_lint_files(spark, sf_dir))


LOGICAL = """
texts AS (SELECT doc_id, translate(coalesce(text, ''), '"''\\' || chr(13), '') AS t FROM documents),
body AS (SELECT doc_id, string_split(t, chr(10)) AS l FROM texts),
inner_lines AS (SELECT doc_id, len(l) AS n, unnest(generate_series(1, len(l))) + 1 AS no, unnest(l) AS s FROM body),
found AS (
  SELECT doc_id AS file, 'E501' AS rule, no AS line_no, 'line too long (' || length(s) || ' > 120 characters)' AS message FROM inner_lines WHERE length(s) > 120
  UNION ALL SELECT doc_id, 'W293', no, 'blank line contains whitespace' FROM inner_lines WHERE s <> '' AND regexp_full_match(s, '[ \\t]*')
  UNION ALL SELECT doc_id, 'W291', no, 'trailing whitespace' FROM inner_lines WHERE NOT regexp_full_match(s, '[ \\t]*') AND regexp_matches(s, '[ \\t]+$')
  UNION ALL SELECT doc_id, 'E302', len(l) + 17, 'expected 2 blank lines, found 1' FROM body WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, 'E303', len(l) + CASE WHEN doc_id % 3 = 0 THEN 23 ELSE 24 END, 'too many blank lines (3)' FROM body WHERE doc_id % 4 = 0)"""


@query("lint_logical_lines", f"""WITH {LOGICAL} SELECT file, rule, CAST(line_no AS INT) AS line_no, message FROM found""")
def lint_logical_lines(spark, sf_dir):
    """Files whose strings and brackets hold blank runs and lines that look like definitions."""
    n = F.col("doc_id")
    text = F.translate(F.coalesce("text", F.lit("")), "\"'\\\r", "")
    quotes = 3 * '"'
    # lines 2 .. n + 1 are the document; then the end of the string and what looks like code in it
    content = F.concat(
        F.lit(f"x = {quotes}\n"), text, F.lit(f"\n\n\n\n\ndef none():\n{quotes}\ny = [\n\n\n\n    1,  # (\n]\nz = 1 + \\\n    2\n"),
        F.when(n % 3 == 0, F.lit("\n")).otherwise(F.lit("\n\n")), F.lit("def f(a):\n    b = {\n"),
        F.when(n % 4 == 0, F.lit("    }\n\n\n\n    return b\n")).otherwise(F.lit("\n\n\n    }\n    return b\n")))
    return lint.violations(read(spark, sf_dir, "documents", "doc_id").select(n.alias("file"), content.alias("content")))


@query("size_format", """
WITH sizes AS (SELECT source, sum(strlen(text)) AS bytes FROM documents GROUP BY 1)
SELECT source, CAST(bytes AS BIGINT) AS bytes,
  CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 1048576 THEN printf('%.1f', bytes / 1024.0) || ' KB'
       ELSE printf('%.2f', bytes / 1048576.0) || ' MB' END AS shown
FROM sizes""")
def size_format(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    sizes = docs.groupBy("source").agg(F.sum(F.octet_length("text")).alias("bytes"))
    return sizes.withColumn("shown", human_size(F.col("bytes")))
