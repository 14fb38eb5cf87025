"""Queries over checks, runs and attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom.functions.compare import arrays_close, keys_equal, maps_match, numbers_match
from patchloom.functions.text import percent
from patchloom.operators import attempts, jobs, prompts, python_units, replay, rollup
from patchloom.plans import derive, flow
from patchloom.plans.prompt_queries import _sql_text
from patchloom.plans.registry import ORACLES, query, read
from patchloom.session import cut_lineage, work_path
from patchloom.sources import corpus, envelopes


@query("pair_match", """
SELECT o_orderkey AS file, CASE WHEN l_orderkey IS NULL THEN 'SKIP' END AS status, r AS refactored
FROM (SELECT o_orderkey, min(o_orderpriority) AS p FROM orders GROUP BY 1) o
LEFT JOIN (SELECT l_orderkey, max(l_returnflag) AS r FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey""")
def pair_match(spark, sf_dir):
    pairs = _order_pairs(spark, sf_dir)
    return pairs.select("file", "status", "refactored")


def _order_pairs(spark, sf_dir):
    originals = read(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("file")).agg(F.min("o_orderpriority").alias("content"))
    rewritten = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.max("l_returnflag").alias("content"))
    return rollup.pair_files(originals, rewritten)


@query("repo_summary", """
WITH s AS (
  SELECT CASE WHEN r IS NULL THEN 'SKIP' WHEN r = 'R' THEN 'FAIL' ELSE 'PASS' END AS status
  FROM (SELECT DISTINCT o_orderkey FROM orders) o
  LEFT JOIN (SELECT l_orderkey, max(l_returnflag) AS r FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey)
SELECT count(*) AS total, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'SKIP') AS skipped,
  count(*) FILTER (status = 'FAIL') AS failed, bool_and(status = 'PASS') AS all_pass, bool_and(status <> 'FAIL') AS pass_or_skip FROM s""")
def repo_summary(spark, sf_dir):
    pairs = _order_pairs(spark, sf_dir)
    judged = pairs.withColumn(
        "status", F.coalesce("status", F.when(F.col("refactored") == "R", F.lit("FAIL")).otherwise(F.lit("PASS"))))
    return rollup.repo_summary(judged)


def _recorded(column: str, texts: dict) -> str:
    cases = " ".join(f"WHEN {k} THEN replace({_sql_text(t)}, '#', {column})" for k, t in texts.items())
    return f"CASE id % 13 {cases} ELSE {column} END"


def _others(column: str) -> str:
    odd = " ".join(f"WHEN id % 13 = {k} AND id % 19 = {f} THEN replace({_sql_text(t)}, '#', {column})" for (k, f), t in derive.RECORDED_ODD.items())
    return f"CASE {odd} ELSE {_recorded(column, {k: t for k, (_, _, t) in derive.RECORDED.items()})} END"


# Which results differ is stated here by id alone: shifted numbers, and the odd forms of arrays, tuples, sets and mappings.
RUNS = f"""
e AS (
  SELECT event_id AS id, 'm' || user_id % 5 AS file, 'f' || user_id % 50 AS func, value, event_type <> 'error' AS old_ok,
         CAST(round(value * 100) AS BIGINT) AS cents FROM events),
c AS (
  SELECT *, id % 13 <= 6 AS is_nested, func <> 'f7' AS there,
    CASE WHEN id % 11 = 0 THEN false ELSE old_ok OR id % 7 = 0 END AS new_ok,
    CASE WHEN id % 17 = 0 THEN 1 ELSE 0 END AS shift,
    CASE WHEN id % 29 = 0 THEN 1 ELSE 0 END AS again,
    (id % 13 = 1 AND id % 19 IN (3, 4, 6)) OR (id % 13 = 2 AND id % 19 = 5) OR (id % 13 = 3 AND id % 19 = 7) OR (id % 13 = 4 AND id % 19 = 8) AS odd,
    CASE WHEN id % 11 = 0 THEN 'RuntimeError' WHEN id % 3 = 0 THEN 'KeyError' ELSE 'ValueError' END AS new_class,
    CASE WHEN id % 11 = 0 THEN 'RuntimeError: boom' WHEN id % 3 = 0 THEN 'KeyError: x' ELSE 'ValueError: other' END AS new_error
  FROM e),
n AS (
  SELECT *, CAST(cents AS VARCHAR) AS old_n, CAST(cents + shift * 100 AS VARCHAR) AS new_n, CAST(cents + (shift + again) * 100 AS VARCHAR) AS again_n FROM c),
w AS (
  SELECT *, {_recorded("old_n", {k: t for k, (_, t, _) in derive.RECORDED.items()})} AS old_whole, {_others("new_n")} AS new_whole,
    {_others("again_n")} AS again_whole
  FROM n),
t AS (
  SELECT *, CASE WHEN length(old_whole) > 80 THEN left(old_whole, 80) || '…' ELSE old_whole END AS old_text,
    CASE WHEN length(new_whole) > 80 THEN left(new_whole, 80) || '…' ELSE new_whole END AS new_text,
    CASE WHEN length(new_whole) > 60 THEN left(new_whole, 60) || '…' ELSE new_whole END AS new_brief,
    CASE WHEN length(again_whole) > 60 THEN left(again_whole, 60) || '…' ELSE again_whole END AS again_brief
  FROM w),
j AS (
  SELECT *,
    CASE WHEN NOT there THEN false
         WHEN old_ok AND new_ok THEN CASE WHEN id % 13 = 5 THEN true WHEN is_nested THEN shift = 0 AND NOT odd WHEN id % 17 = 1 THEN true ELSE shift = 0 END
         WHEN NOT old_ok AND NOT new_ok THEN new_class = 'ValueError' ELSE false END AS passed
  FROM t),
f AS (
  SELECT *, CASE WHEN NOT passed THEN 'args=[' || cents || ']: ' || CASE
      WHEN NOT there THEN 'no refactored run recorded'
      WHEN old_ok AND new_ok THEN 'expected=''' || old_text || ''', got=''' || new_text || ''''
      WHEN NOT old_ok AND NOT new_ok THEN 'orig raised ''ValueError'', refactored raised ''' || new_class || ''''
      WHEN old_ok THEN 'original returned normally, other raised — refactored error: ' || new_error
      ELSE 'refactored returned normally, other raised — refactored error: no error' END END AS failure
  FROM j)"""


@query("replay_compare", f"WITH {RUNS} SELECT file, func, id AS case_id, passed, failure FROM f")
def replay_compare(spark, sf_dir):
    judged = replay.verdicts(replay.pair_runs(derive.recorded_runs(spark, sf_dir)))
    return judged.select("file", "func", "case_id", "passed", "failure")


BY_FUNCTION = RUNS + """,
top AS (SELECT file, func, id, failure FROM f WHERE NOT passed QUALIFY row_number() OVER (PARTITION BY file, func ORDER BY id) <= 5),
lists AS (SELECT file, func, string_agg(failure, chr(10) ORDER BY id) AS failures FROM top GROUP BY 1, 2),
fn AS (
  SELECT f.file, f.func, count(*) AS total, count(*) FILTER (passed) AS passed, bool_or(there) AS ran FROM f GROUP BY 1, 2),
functions AS (
  SELECT fn.file, fn.func, total, passed, passed / total AS pass_rate, passed = total AS ok,
    CASE WHEN NOT ran THEN 'Function ''' || fn.func || ''' missing in refactored module — was it renamed or removed?' ELSE coalesce(failures, '') END AS failures
  FROM fn LEFT JOIN lists USING (file, func))"""


@query("replay_by_function", f"WITH {BY_FUNCTION} SELECT * FROM functions")
def replay_by_function(spark, sf_dir):
    judged = replay.verdicts(replay.pair_runs(derive.recorded_runs(spark, sf_dir)))
    return replay.by_function(judged).withColumn("failures", F.array_join("failures", "\n"))


PROPERTIES = RUNS + """,
props AS (
  SELECT file, func, id AS case_id, 'determinism' AS property,
    CASE WHEN id % 13 = 5 THEN true WHEN is_nested THEN again = 0 WHEN id % 17 = 1 THEN true ELSE again = 0 END AS passed,
    'Non-deterministic: args=[' || cents || '] → ''' || new_brief || ''' ≠ ''' || again_brief || '''' AS m
  FROM f WHERE there AND new_ok
  UNION ALL
  SELECT file, func, id, 'type_stability', is_nested OR id % 23 <> 0,
    'Return-type changed: orig=float, refactored=int for args=[' || cents || ']' FROM f WHERE there AND old_ok AND new_ok
  UNION ALL
  SELECT file, func, id, 'exception_contract', NOT new_ok AND new_class = 'ValueError',
    CASE WHEN new_ok THEN 'Original raised ''ValueError'' but refactored succeeded for args=[' || cents || ']'
         ELSE 'Exception type changed: orig=''ValueError'', refactored=''' || new_class || ''' for args=[' || cents || ']' END
  FROM f WHERE there AND NOT old_ok)"""


@query("property_checks", f"""
WITH {PROPERTIES} SELECT file, func, case_id, property, passed, CASE WHEN passed THEN '' ELSE m END AS message FROM props""")
def property_checks(spark, sf_dir):
    return replay.properties(replay.pair_runs(derive.recorded_runs(spark, sf_dir)))


@query("property_shared", f"""
WITH {PROPERTIES}
SELECT file, func, property, count(*) AS cases, count(*) FILTER (passed) AS held FROM props
WHERE func NOT LIKE 'f%3' GROUP BY 1, 2, 3""")
def property_shared(spark, sf_dir):
    """Properties of functions that are public on both sides; some are private on the second."""
    runs = derive.recorded_runs(spark, sf_dir)
    names = runs.select("file", "func").distinct()
    side = lambda name, column: F.struct(F.lit(name).alias("side"), column.alias("name"))
    hidden = F.when(F.col("func").endswith("3"), F.concat(F.lit("_"), F.col("func"))).otherwise(F.col("func"))
    units = names.select("file", F.inline(F.array(side("original", F.col("func")), side("refactored", hidden)))).withColumns(
        {"kind": F.lit("function"), "top_level": F.lit(True)})
    shared = replay.shared_functions(python_units.public_functions(units))
    found = replay.properties(replay.pair_runs(runs), shared=shared)
    return found.groupBy("file", "func", "property").agg(F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("held"))


@query("replay_aggregate", f"""
WITH {BY_FUNCTION}, {PROPERTIES.split(RUNS + ',')[1]},
broken AS (SELECT file, count(*) AS n FROM props WHERE NOT passed GROUP BY 1)
SELECT file, CAST(sum(total) AS BIGINT) AS total_tests, CAST(sum(passed) AS BIGINT) AS passed_tests, sum(passed) / sum(total) AS pass_rate,
  count(*) AS functions, CAST(max(coalesce(n, 0)) AS BIGINT) AS n_property_failures
FROM functions LEFT JOIN broken USING (file) GROUP BY 1""")
def replay_aggregate(spark, sf_dir):
    cases = replay.pair_runs(derive.recorded_runs(spark, sf_dir))
    failures = replay.properties(cases).filter(~F.col("passed"))
    total = replay.aggregate(replay.by_function(replay.verdicts(cases)), failures)
    return total.select(
        "file", "total_tests", "passed_tests", "pass_rate", F.size("function_results").cast("long").alias("functions"), "n_property_failures")


@query("idempotence_checks", """
WITH runs AS (
  SELECT p_partkey AS id, 'clamp' || p_partkey % 3 AS func, p_size AS x, least(p_size, 30) AS old,
         least(p_size, 30) + CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END AS new FROM part),
old_next AS (SELECT func, x, arg_max(old, old) AS y FROM runs GROUP BY 1, 2),
new_next AS (SELECT func, x, max(new) AS y FROM runs GROUP BY 1, 2),
c AS (
  SELECT r.*, o.y = r.old AS old_same, n.y = r.new AS new_same
  FROM runs r JOIN old_next o ON o.func = r.func AND o.x = r.old JOIN new_next n ON n.func = r.func AND n.x = r.new)
SELECT 'm' AS file, func, id AS case_id, 'idempotence' AS property, new_same AS passed,
  CASE WHEN new_same THEN '' ELSE 'Original is idempotent but refactored is not for args=[' || x || ']' END AS message
FROM c WHERE old_same""")
def idempotence_checks(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    old = F.least(F.col("p_size"), F.lit(30))
    new = old + F.when(F.col("p_size") % 7 == 0, 1).otherwise(0)
    side = lambda name, value: F.struct(F.lit(name).alias("side"), value.alias("y"))
    rows = part.select(
        F.col("p_partkey").alias("case_id"), F.concat(F.lit("clamp"), (F.col("p_partkey") % 3).cast("string")).alias("func"), "p_size",
        F.inline(F.array(side("original", old), side("refactored", new))))
    runs = rows.select(
        F.lit("m").alias("file"), "func", "case_id", "side", F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit("]")).alias("args"),
        F.lit(True).alias("ok"), F.col("y").cast("string").alias("result"), F.col("y").cast("double").alias("result_num"),
        F.lit("int").alias("result_type"), F.lit(None).cast("string").alias("error"))
    return replay.idempotence(runs)


@query("shared_functions", """
WITH s AS (
  SELECT l_orderkey AS file, 'f' || l_linenumber AS func, 'o' AS side FROM lineitem
  UNION ALL SELECT l_orderkey, CASE WHEN l_orderkey % 4 = 3 AND l_linenumber = 1 THEN 'g1' ELSE 'f' || l_linenumber END, 'r' FROM lineitem
    WHERE NOT (l_orderkey % 4 = 1 AND l_linenumber = 1))
SELECT file, func FROM s GROUP BY 1, 2 HAVING count(DISTINCT side) = 2""")
def shared_functions(spark, sf_dir):
    return replay.shared_functions(derive.structure_units(spark, sf_dir))


@query("value_match", """
WITH v AS (
  SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 9 = 1 THEN 'nan'::DOUBLE WHEN event_id % 9 = 2 THEN 'inf'::DOUBLE ELSE value END AS a,
    CASE WHEN event_id % 18 = 0 THEN 0.0 WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 9 = 1 THEN 'nan'::DOUBLE
         WHEN event_id % 18 = 2 THEN '-inf'::DOUBLE WHEN event_id % 9 = 2 THEN 'inf'::DOUBLE
         WHEN event_id % 9 = 3 THEN value * (1 + 1e-12) WHEN event_id % 9 = 4 THEN value + 0.001 ELSE value END AS b
  FROM events)
SELECT event_id, CASE WHEN a IS NULL OR b IS NULL THEN a IS NULL AND b IS NULL WHEN isnan(a) OR isnan(b) THEN isnan(a) AND isnan(b)
  WHEN isinf(a) OR isinf(b) THEN a = b ELSE abs(a - b) <= greatest(1e-9 * greatest(abs(a), abs(b)), 1e-9) END AS same FROM v""")
def value_match(spark, sf_dir):
    n, value = F.col("event_id") % 9, F.col("value")
    m = F.col("event_id") % 18
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    a = F.when(n == 0, F.lit(None)).when(n == 1, nan).when(n == 2, inf).otherwise(value)
    b = (
        F.when(m == 0, F.lit(0.0)).when(n == 0, F.lit(None)).when(n == 1, nan).when(m == 2, -inf).when(n == 2, inf)
        .when(n == 3, value * F.lit(1 + 1e-12)).when(n == 4, value + 0.001).otherwise(value)
    )
    pairs = read(spark, sf_dir, "events").select("event_id", a.alias("a"), b.alias("b"))
    return pairs.select("event_id", numbers_match(F.col("a"), F.col("b")).alias("same"))


@query("array_closeness", """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS a,
    CASE vec_id % 4 WHEN 0 THEN list_transform(embedding::DOUBLE[], lambda x: x * (1 + 1e-6)) WHEN 1 THEN list_transform(embedding::DOUBLE[], lambda x: x + 0.01)
      WHEN 2 THEN (embedding::DOUBLE[])[1:63] ELSE embedding::DOUBLE[] END AS b
  FROM embeddings)
SELECT vec_id, len(a) = len(b) AND coalesce(list_bool_and(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2]) <= 1e-9 + 1e-5 * abs(p[2]))), true) AS close FROM v""")
def array_closeness(spark, sf_dir):
    a = F.col("embedding").cast("array<double>")
    n = F.col("vec_id") % 4
    b = (
        F.when(n == 0, F.transform(a, lambda x: x * (1 + 1e-6))).when(n == 1, F.transform(a, lambda x: x + 0.01))
        .when(n == 2, F.slice(a, 1, 63)).otherwise(a)
    )
    return read(spark, sf_dir, "embeddings").select("vec_id", arrays_close(a, b).alias("close"))


@query("map_match", """
SELECT event_id, event_id % 3 <> 0 AS same_keys, event_id % 3 = 1 OR (event_id % 3 = 2 AND event_id % 2 = 0) AS same_values FROM events""")
def map_match(spark, sf_dir):
    n = F.col("event_id")
    a = F.create_map(F.lit("k"), F.col("value"), F.lit("u"), F.col("user_id").cast("double"))
    other = F.create_map(F.lit("u"), F.col("user_id").cast("double"), F.lit("z"), F.col("value"))
    shifted = F.create_map(F.lit("u"), F.col("user_id").cast("double"), F.lit("k"), F.col("value") + (n % 2))
    b = F.when(n % 3 == 0, other).when(n % 3 == 1, F.create_map(F.lit("u"), F.col("user_id").cast("double"), F.lit("k"), F.col("value"))).otherwise(shifted)
    rows = read(spark, sf_dir, "events").select("event_id", a.alias("a"), b.alias("b"))
    return rows.select(
        "event_id", keys_equal(F.col("a"), F.col("b")).alias("same_keys"),
        maps_match(F.col("a"), F.col("b")).alias("same_values"),
    )


CHECKS = """
base AS (
  SELECT doc_id AS file, doc_id % 19 <> 0 AS c0, n_chars % 3 <> 0 AS c1,
    list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) <= 120 AS c2, quality = 1 AS c3
  FROM documents LEFT JOIN labels USING (doc_id)),
rolled AS (
  SELECT file, c0 AND coalesce(c1, true) AND c2 AND coalesce(c3, true) AS ok_all, c0, c1, c2, c3 FROM base),
results AS (
  SELECT file, CASE WHEN NOT c0 THEN false ELSE ok_all END AS passed,
    CASE WHEN NOT c0 THEN 'error' WHEN NOT ok_all THEN 'warning' ELSE 'pass' END AS severity,
    CASE WHEN NOT c0 THEN '[syntax] SyntaxError at line 1, col 1: bad' WHEN NOT c1 THEN '[ast_structure] count changed'
         WHEN NOT c2 THEN '[linting] lines too long' WHEN NOT c3 THEN '[functional] 1/2 tests passed (50%)' END AS first_failure,
    CASE WHEN NOT c0 THEN 'syntax' ELSE array_to_string(list_filter([CASE WHEN NOT c1 THEN 'ast_structure' END, CASE WHEN NOT c2 THEN 'linting' END,
         CASE WHEN NOT coalesce(c3, true) THEN 'functional' END], lambda x: x IS NOT NULL), ', ') END AS failed_checks,
    CASE WHEN NOT c0 THEN 1 ELSE 3 + CASE WHEN c3 IS NULL THEN 0 ELSE 1 END END AS n_checks
  FROM rolled)"""


def _results(spark, sf_dir):
    return rollup.roll_up(derive.file_checks(spark, sf_dir))


@query("check_rollup", f"""
WITH {CHECKS}
SELECT file, 1 AS attempt, passed, severity, first_failure, failed_checks, CAST(n_checks AS INT) AS n_checks,
  CASE WHEN severity = 'pass' THEN '✓ Validation Passed 100%' ELSE '✗ Validation Failed ' || CAST(floor(100.0 * (n_checks - (len(failed_checks) > 0)::INT) / n_checks + 0.5) AS BIGINT) || '%' END AS badge
FROM results""")
def check_rollup(spark, sf_dir):
    rows = _results(spark, sf_dir)
    n = F.size("checks")
    rate = (n - F.when(F.col("failed_checks") != "", 1).otherwise(0)) / n
    return rows.select(
        "file", "attempt", "passed", "severity", "first_failure", "failed_checks", n.alias("n_checks"),
        rollup.badge(F.col("severity"), rate).alias("badge"))


@query("functional_check", """
WITH o AS (
  SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'ModuleNotFoundError: x' WHEN 1 THEN 'ValueError: y' END AS oe,
    CASE WHEN o_orderkey % 6 = 2 THEN 'TypeError: z' END AS re,
    CASE WHEN o_orderkey % 6 = 3 THEN 0 ELSE 1 + o_custkey % 8 END AS total, o_custkey % 3 AS miss, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 0 END AS pf
  FROM orders),
p AS (SELECT *, greatest(total - miss, 0) AS passed FROM o)
SELECT o_orderkey, coalesce(oe LIKE 'Module%', false) OR (oe IS NULL AND re IS NULL AND CASE WHEN total = 0 THEN pf = 0 ELSE passed = total AND pf = 0 END) AS ok,
  CASE WHEN oe LIKE 'Module%' THEN 'Skipped — unresolvable import (upload the full project for functional testing): ' || oe
    WHEN oe IS NOT NULL THEN 'Could not import original: ' || oe WHEN re IS NOT NULL THEN 'Could not import refactored: ' || re
    WHEN total = 0 THEN 'No testable functions found' || CASE WHEN pf > 0 THEN '; 2 property violation(s)' ELSE '' END
    ELSE passed || '/' || total || ' tests passed (' || CAST(round_even(passed / total * 100, 0) AS INT) || '%)' || CASE WHEN pf > 0 THEN '; 2 property violation(s)' ELSE '' END END AS message
FROM p""")
def functional_check(spark, sf_dir):
    n = F.col("o_orderkey") % 6
    total = F.when(n == 3, F.lit(0)).otherwise(F.col("o_custkey") % 8 + 1)
    rows = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(n == 0, F.lit("ModuleNotFoundError: x")).when(n == 1, F.lit("ValueError: y")).alias("original_error"),
        F.when(n == 2, F.lit("TypeError: z")).alias("refactored_error"), total.alias("total_tests"),
        F.greatest(total - F.col("o_custkey") % 3, F.lit(0)).alias("passed_tests"),
        F.when(F.col("o_orderkey") % 5 == 0, 2).otherwise(0).alias("n_property_failures"))
    return rollup.functional_check(rows).select("o_orderkey", "ok", "message")


@query("rate_format", """
WITH r AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N') AS hit, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(round_even(hit / n * 100, 0) AS INT) || '%' AS even_rate, CAST(floor(hit / n * 100 + 0.5) AS BIGINT) || '%' AS half_up_rate,
  round_even(hit / n, 4) AS rounded FROM r""")
def rate_format(spark, sf_dir):
    rates = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        (F.count_if(F.col("l_returnflag") == "N") / F.count(F.lit(1))).alias("rate"))
    return rates.select(
        "l_orderkey", percent(F.col("rate")).alias("even_rate"), percent(F.col("rate"), half_up=True).alias("half_up_rate"),
        F.bround("rate", 4).alias("rounded"))


def _detailed(spark, sf_dir):
    """Results with per-function detail, and their failed property rows."""
    # judged cases feed four branches, so they are written once
    cases = cut_lineage(replay.verdicts(replay.pair_runs(derive.recorded_runs(spark, sf_dir))))
    failures = replay.properties(cases).filter(~F.col("passed"))
    total = replay.aggregate(replay.by_function(cases), failures)
    ok = F.col("passed_tests") == F.col("total_tests")
    check = F.struct(F.lit(0).alias("ord"), F.lit("functional").alias("check"), ok.alias("passed"), F.lit("see functions").alias("message"))
    rows = total.withColumn("checks", F.array(check)).withColumn("passed", ok).withColumn(
        "severity", F.when(ok, F.lit("pass")).otherwise(F.lit("warning"))).withColumn(
        "failed_checks", F.when(ok, F.lit("")).otherwise(F.lit("functional")))
    return rows, failures


@query("report_json", f"""
WITH {BY_FUNCTION}, {PROPERTIES.split(RUNS + ',')[1]},
numbered AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY file ORDER BY func, case_id, property) - 1) // {rollup.REPORT_PART_ROWS} AS INT) AS part
  FROM props WHERE NOT passed),
lists_of AS (
  SELECT file, part, list({{'function': func, 'property': property, 'message': m}} ORDER BY func, case_id, property) AS violations
  FROM numbered GROUP BY 1, 2),
shown AS (
  SELECT fn.file, fn.func, {{'total': f.total, 'passed': f.passed, 'pass_rate': f.pass_rate, 'failures': CASE WHEN NOT ran THEN [f.failures]
    ELSE coalesce((SELECT list(failure ORDER BY id) FROM top WHERE top.file = fn.file AND top.func = fn.func), []) END}} AS v
  FROM fn JOIN functions f USING (file, func)),
total AS (
  SELECT file, CAST(sum(total) AS BIGINT) AS tests, CAST(sum(passed) AS BIGINT) AS good, sum(passed) / sum(total) AS rate,
    (SELECT map_from_entries(list({{'k': func, 'v': v}} ORDER BY func)) FROM shown s WHERE s.file = functions.file) AS results
  FROM functions GROUP BY 1),
parts AS (SELECT file, 0 AS part FROM total UNION SELECT file, part FROM lists_of)
SELECT file, part, CAST(CASE WHEN violations IS NULL THEN to_json({{'timestamp': '2024-01-01T00:00:00.000000Z', 'file': file, 'passed': tests = good,
    'severity': CASE WHEN tests = good THEN 'pass' ELSE 'warning' END, 'pass_rate': rate, 'checks': {{'functional': {{'passed': tests = good, 'message': 'see functions'}}}},
    'functional_detail': {{'total_tests': tests, 'passed_tests': good, 'pass_rate': rate, 'function_results': results}}}})
  ELSE to_json({{'timestamp': '2024-01-01T00:00:00.000000Z', 'file': file, 'passed': tests = good,
    'severity': CASE WHEN tests = good THEN 'pass' ELSE 'warning' END, 'pass_rate': rate, 'checks': {{'functional': {{'passed': tests = good, 'message': 'see functions'}}}},
    'functional_detail': {{'total_tests': tests, 'passed_tests': good, 'pass_rate': rate, 'function_results': results, 'property_failures': violations}}}}) END AS VARCHAR) AS report
FROM parts JOIN total USING (file) LEFT JOIN lists_of USING (file, part)""")
def report_json(spark, sf_dir):
    return rollup.json_reports(*_detailed(spark, sf_dir), generated=F.lit("2024-01-01 00:00:00").cast("timestamp"))


RULE, THIN = "=" * 64, "-" * 64


@query("report_text", f"""
WITH {BY_FUNCTION}, {PROPERTIES.split(RUNS + ',')[1]},
bars AS (
  SELECT file, func, row_number() OVER (PARTITION BY file, func ORDER BY id) AS n, '       ↳ ' || left(failure, 100) AS line FROM top
  QUALIFY n <= 3),
shown AS (
  SELECT fn.file, fn.func, '  ' || CASE WHEN f.pass_rate = 1 THEN '✓' ELSE '✗' END || '  ' || rpad(fn.func, 30, ' ') || '  ' || f.passed || '/' || f.total
      || ' (' || CAST(round_even(f.pass_rate * 100, 0) AS INT) || '%)'
      || CASE WHEN NOT fn.ran THEN chr(10) || '       ↳ ' || left(f.failures, 100)
              ELSE coalesce(chr(10) || (SELECT string_agg(line, chr(10) ORDER BY n) FROM bars b WHERE b.file = fn.file AND b.func = fn.func), '') END AS line
  FROM fn JOIN functions f USING (file, func)),
worst AS (
  SELECT file, row_number() OVER (PARTITION BY file ORDER BY func, case_id, property) AS n, '  ✗  [' || property || '] ' || func || ': ' || left(m, 100) AS line
  FROM props WHERE NOT passed QUALIFY n <= 10),
total AS (SELECT file, sum(passed) = sum(total) AS ok, sum(passed) / sum(total) AS rate FROM functions GROUP BY 1)
SELECT file, concat_ws(chr(10), '{RULE}', '  CODE VALIDATION REPORT', '  File      : ' || file, '  Generated : 2024-01-01 00:00:00 UTC', '{RULE}',
    chr(10) || '  Overall Status : ' || CASE WHEN ok THEN '✓ PASS' ELSE '✗ FAIL' END, '  Severity       : ' || CASE WHEN ok THEN 'PASS' ELSE 'WARNING' END,
    '  Pass Rate      : ' || printf('%.1f', round_even(rate * 100, 1)) || '%', '', '{THIN}', '  CHECK RESULTS', '{THIN}',
    '  ' || CASE WHEN ok THEN '✓' ELSE '✗' END || '  ' || rpad('functional', 22, ' ') || '  │  see functions',
    '', '{THIN}', '  PER-FUNCTION BREAKDOWN', '{THIN}', (SELECT string_agg(line, chr(10) ORDER BY func) FROM shown s WHERE s.file = total.file),
    (SELECT chr(10) || '{THIN}' || chr(10) || '  PROPERTY VIOLATIONS' || chr(10) || '{THIN}' || chr(10) || string_agg(line, chr(10) ORDER BY n) FROM worst w WHERE w.file = total.file),
    '', '{RULE}') AS report
FROM total""")
def report_text(spark, sf_dir):
    return rollup.text_reports(*_detailed(spark, sf_dir), generated=F.lit("2024-01-01 00:00:00").cast("timestamp"))


REPORT_TEXT = ORACLES["report_text"]


@query("retry_prompts", f"""
WITH {BY_FUNCTION}, {PROPERTIES.split(RUNS + ',')[1]},
reports AS ({REPORT_TEXT}),
wrong AS (
  SELECT file, string_agg('  - [property:' || property || '] ' || func || ' — ' || m, chr(10) ORDER BY func, case_id, property) AS lines
  FROM props WHERE NOT passed GROUP BY 1),
total AS (SELECT file, sum(passed) = sum(total) AS ok FROM functions GROUP BY 1),
filled AS (
  SELECT file, replace(replace(replace({_sql_text(prompts.RETRY)}, '{{severity}}', 'WARNING'), '{{failed_block}}',
      '  - [functional] see functions' || coalesce(chr(10) || lines, '')), '{{report_text}}', report) AS context
  FROM total JOIN reports USING (file) LEFT JOIN wrong USING (file) WHERE NOT ok)
SELECT file, n AS prompt_id, context || 'Task ' || n || ' of ' || file AS prompt FROM filled, (SELECT unnest([1, 2]) AS n)""")
def retry_prompts(spark, sf_dir):
    results, failures = _detailed(spark, sf_dir)
    n = F.col("prompt_id").cast("string")
    sent = results.select("file", F.explode(F.array(F.lit(1), F.lit(2))).alias("prompt_id")).withColumn(
        "prompt", F.concat(F.lit("Task "), n, F.lit(" of "), "file"))
    made = flow.retry_prompts(sent, results, failures, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return made.select("file", "prompt_id", "prompt")


@query("report_roundtrip", f"""
WITH {BY_FUNCTION}, {PROPERTIES.split(RUNS + ',')[1]},
broken AS (SELECT file, count(*) AS n FROM props WHERE NOT passed GROUP BY 1)
SELECT file, sum(passed) = sum(total) AS passed, CASE WHEN sum(passed) = sum(total) THEN 'pass' ELSE 'warning' END AS severity,
  CAST(sum(total) AS BIGINT) AS total_tests, count(*) AS functions, CAST(max(coalesce(n, 0)) AS BIGINT) AS violations
FROM functions LEFT JOIN broken USING (file) GROUP BY 1""")
def report_roundtrip(spark, sf_dir):
    reports = envelopes.parse_reports(rollup.json_reports(*_detailed(spark, sf_dir)))
    d = F.col("doc.functional_detail")
    # every part repeats the totals and has its own violations
    return reports.groupBy("file", "doc.passed", "doc.severity").agg(
        F.max(d["total_tests"]).alias("total_tests"), F.max(F.size(d["function_results"])).cast("long").alias("functions"),
        F.sum(F.coalesce(F.size(d["property_failures"]), F.lit(0))).alias("violations"))


@query("report_checks", """
SELECT doc_id AS file, CASE doc_id % 4 WHEN 0 THEN quality = 1 WHEN 1 THEN quality = 1 WHEN 2 THEN true END AS passed,
  CASE doc_id % 4 WHEN 0 THEN 'q' || quality WHEN 1 THEN 'q' || quality WHEN 2 THEN '' END AS message
FROM labels""")
def report_checks(spark, sf_dir):
    n, q = F.col("doc_id") % 4, F.col("quality").cast("string")
    ok = F.when(F.col("quality") == 1, F.lit("true")).otherwise(F.lit("false"))
    text = (
        F.when(n == 0, F.concat(F.lit('{"passed": '), ok, F.lit(', "message": "q'), q, F.lit('"}')))
        .when(n == 1, F.concat(F.lit("["), ok, F.lit(', "q'), q, F.lit('"]')))
        .when(n == 2, F.lit("{}"))
    )
    rows = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("file"), text.alias("entry"))
    parsed = rows.select("file", "entry", envelopes.check_entry(F.col("entry")).alias("c"))
    keep = F.col("entry").isNotNull()
    return parsed.select("file", F.when(keep, F.col("c.passed")).alias("passed"), F.when(keep, F.col("c.message")).alias("message"))


@query("console_lines", f"""
WITH {CHECKS}
SELECT file, CASE WHEN passed THEN '✓ Validation PASSED [' ELSE '✗ Validation FAILED [' END || upper(severity) || ']  pass_rate=50.0%'
  || CASE WHEN failed_checks <> '' THEN '  (failed: ' || failed_checks || ')' ELSE '' END AS line FROM results""")
def console_lines(spark, sf_dir):
    return rollup.console_line(_results(spark, sf_dir).withColumn("pass_rate", F.lit(0.5)))


@query("summary_sink", f"""
WITH {CHECKS}
SELECT file, CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END AS status, severity, CAST(0.5 AS DOUBLE) AS pass_rate, first_failure AS error FROM results""")
def summary_sink(spark, sf_dir):
    """The consolidated report written and read back."""
    path = work_path(spark, "summary")
    rows = _results(spark, sf_dir)
    rollup.write_summary(rows.withColumns({"pass_rate": F.lit(0.5), "status": rollup.status(F.col("passed"))}), path)
    schema = f"file {rows.schema['file'].dataType.simpleString()}, status string, pass_rate double, severity string, error string"
    return spark.read.schema(schema).json(path)


STAGES = CHECKS + """,
first AS (
  SELECT file, file % 13 <> 0 AS s1, file % 13 <> 0 AND file % 17 <> 0 AS s2, file % 13 <> 0 AND file % 17 <> 0 AND file % 23 <> 0 AS s3, passed, severity, first_failure FROM results),
att AS (
  SELECT file, CASE WHEN s3 THEN passed END AS val_passed, CASE WHEN s3 THEN severity ELSE '—' END AS val_severity,
    CASE WHEN s3 AND passed THEN 1.0 WHEN s3 THEN 0.5 END AS val_pass_rate,
    CASE WHEN NOT s1 THEN 'Stage 1 failed' WHEN NOT s2 THEN 'Stage 2 failed' WHEN NOT s3 THEN 'Stage 3 failed' ELSE coalesce(first_failure, '—') END AS val_error
  FROM first),
again AS (
  SELECT file, CASE WHEN file % 5 <> 0 THEN file % 2 = 0 END AS retry_val_passed,
    CASE WHEN file % 5 = 0 THEN '—' WHEN file % 2 = 0 THEN '—' ELSE '[linting] still failing after the second attempt was made' END AS retry_error
  FROM att WHERE val_passed = false),
merged AS (
  SELECT a.*, r.file IS NOT NULL AS retried, retry_val_passed,
    CASE WHEN r.file IS NOT NULL AND retry_val_passed IS NOT NULL THEN CASE WHEN retry_val_passed THEN 'PASS' ELSE 'FAIL' END
         WHEN val_passed IS NULL THEN 'SKIP' WHEN val_passed THEN 'PASS' ELSE 'FAIL' END AS final_status,
    coalesce(CASE WHEN retry_error <> '—' THEN retry_error END, val_error) AS error
  FROM att a LEFT JOIN again r USING (file))"""


def _first_attempt(spark, sf_dir):
    n = F.col("file")
    staged = attempts.gate_stages(_results(spark, sf_dir).withColumns(
        {"stage1_ok": n % 13 != 0, "stage2_ok": n % 17 != 0, "stage3_ok": n % 23 != 0}))
    s3 = F.col("stage3_ok")
    return staged.select(
        "file", F.when(s3, F.col("passed")).alias("val_passed"), F.when(s3, F.col("severity")).otherwise(F.lit("—")).alias("val_severity"),
        F.when(s3 & F.col("passed"), F.lit(1.0)).when(s3, F.lit(0.5)).alias("val_pass_rate"),
        F.when(s3, F.coalesce("first_failure", F.lit("—"))).otherwise(
            attempts.stage_error(F.col("stage1_ok"), F.col("stage2_ok"), s3)).alias("val_error"))


def _merged(spark, sf_dir):
    first = _first_attempt(spark, sf_dir)
    n = F.col("file")
    second = attempts.to_retry(first).select(
        "file", F.when(n % 5 != 0, n % 2 == 0).alias("retry_val_passed"), F.lit("warning").alias("retry_severity"),
        F.when((n % 5 == 0) | (n % 2 == 0), F.lit("—")).otherwise(F.lit("[linting] still failing after the second attempt was made")).alias("retry_error"))
    return attempts.merge_attempts(first, second)


@query("retry_select", f"WITH {STAGES} SELECT file, val_severity, val_error FROM att WHERE val_passed = false")
def retry_select(spark, sf_dir):
    return attempts.to_retry(_first_attempt(spark, sf_dir)).select("file", "val_severity", "val_error")


@query("final_status", f"WITH {STAGES} SELECT file, retried, final_status, error FROM merged")
def final_status(spark, sf_dir):
    return _merged(spark, sf_dir).select("file", "retried", "final_status", "error")


@query("summary_rows", f"""
WITH {STAGES}
SELECT file, CASE WHEN val_passed THEN '✓ PASS' WHEN NOT val_passed THEN '✗ FAIL' ELSE '— SKIP' END AS validation, val_severity AS severity,
  CASE WHEN val_pass_rate IS NULL THEN '—' WHEN val_pass_rate = 1 THEN '100%' ELSE '50%' END AS pass_rate,
  CASE WHEN NOT retried THEN '—' WHEN retry_val_passed THEN '✓ PASS' WHEN NOT retry_val_passed THEN '✗ FAIL' ELSE '— SKIP' END AS after_retry,
  CASE WHEN length(error) > 40 THEN left(error, 39) || '…' ELSE error END AS notes
FROM merged""")
def summary_rows(spark, sf_dir):
    return attempts.summary_rows(_merged(spark, sf_dir))


@query("run_summary", f"""
WITH {STAGES}
SELECT count(*) AS total, count(*) FILTER (final_status = 'PASS') AS passed, count(*) FILTER (final_status = 'FAIL') AS failed,
  count(*) FILTER (final_status = 'SKIP') AS skipped, count(*) FILTER (retried) AS retried,
  count(*) FILTER (retried AND coalesce(retry_val_passed, false)) AS recovered, bool_and(final_status = 'PASS') AS all_pass FROM merged""")
def run_summary(spark, sf_dir):
    return attempts.run_summary(_merged(spark, sf_dir))


ARTEFACTS = """
art AS (
  SELECT doc_id % 20 AS job_id, doc_id AS file, text AS original_code, CASE WHEN doc_id % 7 <> 0 THEN 'new ' || text END AS refactored_code,
    CASE WHEN l.quality IS NOT NULL THEN '{"severity":"' || CASE WHEN l.quality = 1 THEN 'pass' ELSE 'warning' END || '"}' END AS validation_report
  FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id))"""


def _artefacts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    key = F.col("doc_id").alias("file")
    originals = docs.select(key, F.col("doc_id").alias("ord"), F.col("text").alias("content"))
    rewritten = docs.filter("doc_id % 7 <> 0").select(key, F.concat(F.lit("new "), "text").alias("content"))
    reports = read(spark, sf_dir, "labels").groupBy(key).agg(F.max("quality").alias("q")).select(
        "file", F.to_json(F.struct(F.when(F.col("q") == 1, F.lit("pass")).otherwise(F.lit("warning")).alias("severity"))).alias("report"))
    return jobs.artefacts(originals, rewritten, reports).withColumn("job_id", F.col("file") % 20)


@query("artefact_join", f"WITH {ARTEFACTS} SELECT file, original_code, refactored_code, validation_report FROM art")
def artefact_join(spark, sf_dir):
    return _artefacts(spark, sf_dir).select("file", "original_code", "refactored_code", "validation_report")


@query("primary_result", f"""
WITH {ARTEFACTS}
SELECT job_id, file, refactored_code, validation_report FROM art WHERE coalesce(refactored_code, '') <> ''
QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY file) = 1""")
def primary_result(spark, sf_dir):
    return jobs.primary_result(_artefacts(spark, sf_dir))


@query("source_lookup", """
WITH f AS (SELECT source || '/d' || doc_id // 2 || '.py' AS path, min(text) AS content FROM documents GROUP BY 1),
b AS (SELECT regexp_extract(path, '[^/]*$') AS base, min(path) AS path FROM f GROUP BY 1),
w AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source || '/d' || doc_id // 2 || '.py' WHEN 1 THEN 'gone/d' || doc_id // 2 || '.py' ELSE 'gone/x' || doc_id END AS file FROM documents),
r AS (SELECT w.doc_id, w.file, coalesce(f.path, b.path) AS resolved FROM w LEFT JOIN f ON f.path = w.file LEFT JOIN b ON b.base = regexp_extract(w.file, '[^/]*$'))
SELECT r.doc_id, r.file, r.resolved, f.content FROM r LEFT JOIN f ON f.path = r.resolved""")
def source_lookup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    name = F.concat(F.lit("/d"), F.floor(F.col("doc_id") / 2).cast("string"), F.lit(".py"))
    files = docs.groupBy(F.concat("source", name).alias("file")).agg(F.min("text").alias("content"))
    n = F.col("doc_id") % 3
    wanted = docs.select("doc_id", F.when(n == 0, F.concat("source", name)).when(n == 1, F.concat(F.lit("gone"), name)).otherwise(
        F.concat(F.lit("gone/x"), F.col("doc_id").cast("string"))).alias("file"))
    return corpus.lookup_source(wanted, files).select("doc_id", "file", "resolved", "content")
