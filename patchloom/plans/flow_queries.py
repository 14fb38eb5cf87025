"""Queries that run several stages in a row over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom import config
from patchloom.plans import derive, flow, rounds
from patchloom.plans.prompt_queries import EXAMPLE_SCHEMA, EXAMPLES
from patchloom.plans.registry import query
from patchloom.session import cut_lineage


def _corpus(spark, sf_dir):
    """The Python and the brace files of all documents under paths with their extensions."""
    python = derive.python_files(spark, sf_dir).select("file", "content")
    ending = F.when(F.col("language") == "javascript", F.lit(".js")).when(F.col("language") == "go", F.lit(".go")).otherwise(F.lit(".c"))
    braces = derive.brace_files(spark, sf_dir).select(F.concat("file", ending).alias("file"), "content")
    return python.unionByName(braces)


@query("corpus_chunks", """
WITH n AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents),
units AS (
  SELECT 'p/d' || doc_id || '.py' AS file, 'python' AS language, unnest(['class', 'method', 'function']) AS type, unnest([1, 2, 3]) AS no,
    unnest([1, 2, 6]) AS start_line, unnest([3, 3, 8 + n]) AS end_line FROM n WHERE doc_id % 9 <> 0
  UNION ALL
  SELECT 'b/d' || doc_id || ['.js', '.go', '.c'][1 + doc_id % 3], ['javascript', 'go', 'c'][1 + doc_id % 3],
    unnest(['function', CASE WHEN doc_id % 3 = 0 THEN 'class' ELSE 'struct' END]), unnest([1, 2]), unnest([1, 8 + n]), unnest([5 + n, 11 + n]) FROM n)
SELECT file, language, 'chunk_' || no AS chunk_id, type, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line FROM units""")
def corpus_chunks(spark, sf_dir):
    made = flow.chunk_corpus(_corpus(spark, sf_dir))
    return made.chunks.select("file", "language", "chunk_id", "type", "start_line", "end_line")


@query("splice_round_trip", """
SELECT 'p/d' || doc_id || '.py' AS file, true AS same FROM documents
UNION ALL SELECT 'b/d' || doc_id || ['.js', '.go', '.c'][1 + doc_id % 3], true FROM documents""")
def splice_round_trip(spark, sf_dir):
    """Chunks become prompts, replies give the code back, and every file must come out as it went in."""
    files = _corpus(spark, sf_dir)
    examples = config.table(spark, EXAMPLES, EXAMPLE_SCHEMA)
    prompts = flow.build_prompts(flow.chunk_corpus(files).chunks, files, examples, batch_size=2)
    # pieces are read by the replies and again by the splice, as a retry would reuse them
    prompts = cut_lineage(prompts.select("file", "prompt_id", "is_batch", "chunks"))
    block = F.transform("chunks", lambda c: F.concat(
        F.lit('<chunk id="'), c["chunk_id"], F.lit('">\n```\n'), c["code"], F.lit("\n```\n</chunk>")))
    replies = prompts.select("file", "prompt_id", F.array_join(block, "\n").alias("reply"))
    done = flow.apply_replies(files, prompts, replies)
    before = files.select("file", F.sha2("content", 256).alias("was"))
    after = done.files.select("file", F.sha2("content", 256).alias("now"))
    return before.join(after, "file", "left").select("file", F.col("was").eqNullSafe(F.col("now")).alias("same"))


BAD_LINT = """(list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) + 6 > 120
    OR regexp_matches(chr(10) || text, '\\n *(\\n|$)') OR regexp_matches(text, '[ \\t](\\n|$)'))"""


@query("validate_files", f"""
WITH d AS (SELECT doc_id, doc_id % 10 = 3 AS gone, doc_id % 9 = 0 AS broken, doc_id % 7 = 0 AS changed, {BAD_LINT} AS dirty FROM documents)
SELECT 'p/d' || doc_id || '.py' AS file, CASE WHEN gone THEN 'SKIP' WHEN broken OR changed OR dirty THEN 'FAIL' ELSE 'PASS' END AS status,
  CASE WHEN gone THEN 'skip' WHEN broken THEN 'error' WHEN changed OR dirty THEN 'warning' ELSE 'pass' END AS severity,
  CASE WHEN gone OR broken THEN NULL WHEN changed THEN 'Function ''f' || doc_id || ''': positional arg count changed 2 → 3'
       ELSE 'AST structure preserved' END AS structure,
  CASE WHEN gone THEN NULL WHEN broken THEN 0.0 ELSE 1.0 END::DOUBLE AS pass_rate
FROM d""")
def validate_files(spark, sf_dir):
    """Originals against a rewritten side that is missing, broken or changed by id."""
    rewritten = derive.python_files(spark, sf_dir)
    originals = rewritten.select("file", F.regexp_replace("content", r"\*args\)\n", "*args):\n").alias("content"))
    changed = F.when(
        F.col("doc_id") % 7 == 0, F.replace("content", F.lit("(a, b=1"), F.lit("(a, b=1, c=2"))
    ).otherwise(F.col("content"))
    new = rewritten.filter("doc_id % 10 <> 3").select("file", changed.alias("content"))
    results, _ = flow.validate(originals, new)
    shape = F.get(F.filter("checks", lambda c: c["check"] == "ast_structure"), F.lit(0))["message"]
    return results.select("file", "status", "severity", shape.alias("structure"), "pass_rate")


@query("retry_rounds", f"""
WITH d AS (
  SELECT doc_id, doc_id % 9 = 0 AS broken, doc_id % 10 = 3 AS silent, doc_id % 7 = 0 AS wrong, doc_id % 14 = 0 AS mended, {BAD_LINT} AS dirty FROM documents),
s AS (SELECT *, broken OR silent AS gone, wrong OR dirty AS bad, (wrong AND NOT mended) OR dirty AS still FROM d)
SELECT 'p/d' || doc_id || '.py' AS file, CASE WHEN NOT gone THEN NOT bad END AS val_passed, NOT gone AND bad AS retried,
  CASE WHEN NOT gone AND bad THEN NOT still END AS retry_val_passed, CASE WHEN NOT gone AND bad THEN mended END AS changed,
  CASE WHEN gone THEN 'SKIP' WHEN bad AND still THEN 'FAIL' ELSE 'PASS' END AS final_status,
  CASE WHEN broken THEN 'Stage 1 failed' WHEN silent THEN 'Stage 3 failed' END AS stopped,
  CASE WHEN gone THEN NULL WHEN wrong AND NOT mended THEN 3 ELSE 2 END AS arguments
FROM s""")
def retry_rounds(spark, sf_dir):
    """Two attempts from prompts to merged rows: some replies change a signature, half of those are mended
    when asked again, and some files never get an answer."""
    docs = derive.python_files(spark, sf_dir).select("file", "content")
    examples = config.table(spark, EXAMPLES, EXAMPLE_SCHEMA)

    def answer(prompts, attempt):
        number = F.regexp_extract("file", r"d(\d+)\.py$", 1).cast("long")
        wrong = (number % 7 == 0) & ((number % 14 != 0) | F.lit(attempt == 1))
        code = lambda c: F.when(wrong, F.replace(c["code"], F.lit("(a, b=1,"), F.lit("(a, b=1, c=2,"))).otherwise(c["code"])
        block = F.transform("chunks", lambda c: F.concat(F.lit('<chunk id="'), c["chunk_id"], F.lit('">\n```\n'), code(c), F.lit("\n```\n</chunk>")))
        return prompts.filter(number % 10 != 3).select("file", "prompt_id", F.array_join(block, "\n").alias("reply"))

    done = rounds.run_rounds(docs, examples, answer, batch_size=3)
    changed = done.attempts.filter("attempt = 2").select("file", "changed")
    left = done.files.select("file", F.when(F.contains("content", F.lit("(a, b=1, c=2,")), 3).otherwise(2).alias("arguments"))
    stopped = F.when(F.col("final_status") == "SKIP", F.col("error"))
    return done.merged.join(changed, "file", "left").join(left, "file", "left").select(
        "file", "val_passed", "retried", "retry_val_passed", "changed", "final_status", stopped.alias("stopped"), "arguments")
