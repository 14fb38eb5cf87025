"""Checks to results: severity, first failure, pass rates, summaries, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from patchloom.functions.text import cut, percent
from patchloom.skew import scan_within

# Functional check messages and the text of skipped pairs.
NO_TESTS = "No testable functions found"
SKIPPED_IMPORT = "Skipped — unresolvable import (upload the full project for functional testing): "
BAD_ORIGINAL = "Could not import original: "
BAD_REFACTORED = "Could not import refactored: "
SKIP_ERROR = "Refactored file not found: "
REPORT_PART_ROWS = 10_000


def pair_files(originals: DataFrame, refactored: DataFrame) -> DataFrame:
    """``file, original, refactored, status``: SKIP where no rewritten file exists.

    Both inputs have one row per relative path.
    """
    joined = originals.select("file", F.col("content").alias("original")).join(
        refactored.select("file", F.col("content").alias("refactored"), F.lit(True).alias("_there")), "file", "left"
    )
    return joined.withColumn("status", F.when(F.col("_there").isNull(), F.lit("SKIP"))).drop("_there")


def functional_check(rows: DataFrame) -> DataFrame:
    """Adds ``ok, message``. Rows: ``original_error, refactored_error, total_tests,
    passed_tests, n_property_failures``; errors are null when loading worked."""
    missing = F.col("original_error").rlike("ImportError|ModuleNotFoundError")
    total, passed = F.coalesce("total_tests", F.lit(0)), F.coalesce("passed_tests", F.lit(0))
    broken = F.coalesce("n_property_failures", F.lit(0))
    tail = F.when(broken > 0, F.concat(F.lit("; "), broken.cast("string"), F.lit(" property violation(s)"))).otherwise(F.lit(""))
    return rows.withColumn(
        "ok",
        F.when(missing, F.lit(True))
        .when(F.col("original_error").isNotNull() | F.col("refactored_error").isNotNull(), F.lit(False))
        .when(total == 0, broken == 0)
        .otherwise((passed == total) & (broken == 0)),
    ).withColumn(
        "message",
        F.when(missing, F.concat(F.lit(SKIPPED_IMPORT), F.col("original_error")))
        .when(F.col("original_error").isNotNull(), F.concat(F.lit(BAD_ORIGINAL), F.col("original_error")))
        .when(F.col("refactored_error").isNotNull(), F.concat(F.lit(BAD_REFACTORED), F.col("refactored_error")))
        .when(total == 0, F.concat(F.lit(NO_TESTS), tail))
        .otherwise(F.concat(
            passed.cast("string"), F.lit("/"), total.cast("string"), F.lit(" tests passed ("),
            percent(passed / total), F.lit(")"), tail)),
    )


def roll_up(checks: DataFrame, gate: bool = True) -> DataFrame:
    """``file, attempt, passed, severity, first_failure, failed_checks, checks`` per file and attempt.

    A check name counts once (its last row by ``ord`` wins), so the lists below hold
    one entry per check name. With ``gate`` a failed syntax check hides all others.
    """
    named = checks.groupBy("file", "attempt", "check").agg(
        F.min("ord").alias("ord"), F.max(F.struct("ord", "ok", "message")).alias("last")
    ).select("file", "attempt", F.struct("ord", "check", F.col("last.ok").alias("passed"), "last.message").alias("c"))
    grouped = named.groupBy("file", "attempt").agg(F.sort_array(F.collect_list("c")).alias("_all"))
    return judged(grouped, gate).select("file", "attempt", *VERDICT)


VERDICT = ["passed", "severity", "first_failure", "failed_checks", "checks"]


def judged(rows: DataFrame, gate: bool = True) -> DataFrame:
    """The columns of ``VERDICT`` from ``_all``, the checks of a file in order; other columns stay."""
    syntax = F.filter("_all", lambda c: (c["check"] == "syntax") & ~c["passed"])
    shown = F.when(F.size(syntax) > 0, syntax).otherwise(F.col("_all")) if gate else F.col("_all")
    first = F.get("_failed", F.lit(0))
    return rows.withColumns({"checks": shown, "_broken": F.size(syntax) > 0}).withColumn(
        "_failed", F.filter("checks", lambda c: ~c["passed"])).withColumns({
            "passed": F.size("_failed") == 0,
            "severity": F.when(F.col("_broken"), F.lit("error")).when(F.size("_failed") > 0, F.lit("warning")).otherwise(F.lit("pass")),
            "first_failure": F.when(F.size("_failed") > 0, F.concat(F.lit("["), first["check"], F.lit("] "), first["message"])),
            "failed_checks": F.array_join(F.transform("_failed", lambda c: c["check"]), ", "),
        }).drop("_all", "_broken", "_failed")


def status(passed: Column) -> Column:
    return F.when(passed.isNull(), F.lit("SKIP")).when(passed, F.lit("PASS")).otherwise(F.lit("FAIL"))


def repo_summary(results: DataFrame) -> DataFrame:
    """``total, passed, skipped, failed, all_pass, pass_or_skip`` from rows with ``status``."""
    state = F.col("status")
    return results.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(state == "PASS").alias("passed"),
        F.count_if(state == "SKIP").alias("skipped"),
        F.bool_and(state == "PASS").alias("all_pass"),
        F.bool_and(state.isin("PASS", "SKIP")).alias("pass_or_skip"),
    ).withColumn("failed", F.col("total") - F.col("passed") - F.col("skipped"))


def write_summary(results: DataFrame, path: str) -> None:
    """The consolidated report: one JSON object per result row, as many part files as tasks."""
    named = F.map_from_entries(F.transform("checks", lambda c: F.struct(c["check"], c["passed"])))
    results.select(
        "file", "status", "pass_rate", "severity", F.col("first_failure").alias("error"), named.alias("checks")
    ).write.mode("errorifexists").json(path, ignoreNullFields=False)


def badge(severity: Column, pass_rate: Column) -> Column:
    """Viewer badge; null for an empty report."""
    word = F.when(severity == "pass", F.lit("✓ Validation Passed ")).otherwise(F.lit("✗ Validation Failed "))
    return F.when(severity.isNotNull(), F.concat(word, percent(pass_rate, half_up=True)))


def json_reports(
    results: DataFrame, failures: DataFrame | None = None, part_rows: int = REPORT_PART_ROWS,
    heavy: dict | None = None, generated: Column | None = None,
) -> DataFrame:
    """``file, part, report`` JSON text.

    ``results``: ``file, passed, severity, pass_rate, checks`` and, when functional
    tests ran, ``total_tests, passed_tests, function_results``. ``failures`` are failed
    property rows; a file with more than ``part_rows`` of them gets further parts.
    ``generated`` is the time shown, by default that of the query.
    """
    made = F.current_timestamp() if generated is None else generated
    entries = F.transform("checks", lambda c: F.struct(
        c["check"].alias("k"), F.struct(c["passed"].alias("passed"), c["message"].alias("message")).alias("v")))
    detail = F.lit(None).cast("string")
    rows = results.withColumn("part", F.lit(0))
    if failures is not None:
        ranked = scan_within(
            failures, ["file"], [F.col("func"), F.col("case_id"), F.col("property")], rank="_n", heavy=heavy
        ).withColumn("part", F.floor((F.col("_n") - 1) / part_rows).cast("int"))
        lists = ranked.groupBy("file", "part").agg(F.sort_array(F.collect_list(F.struct(
            "_n", F.struct(F.col("func").alias("function"), "property", "message").alias("f")))).alias("_f"))
        parts = lists.select("file", "part", F.transform("_f", lambda x: x["f"]).alias("property_failures"))
        own = results.select("file", F.lit(0).alias("part")).unionByName(
            parts.filter("part > 0").select("file", "part"))
        rows = own.join(results, "file").join(parts, ["file", "part"], "left")
        detail = F.when(F.col("total_tests").isNotNull(), F.struct(
            "total_tests", "passed_tests", F.coalesce("pass_rate", F.lit(0.0)).alias("pass_rate"),
            "function_results", "property_failures"))
    fields = [
        F.date_format(made, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
        "file", "passed", "severity", "pass_rate", F.map_from_entries(entries).alias("checks"),
    ]
    if failures is not None:
        fields.append(detail.alias("functional_detail"))
    return rows.select("file", "part", F.to_json(F.struct(*fields)).alias("report"))


# Report layout (rules, headings, widths and caps below).
RULE, THIN = "=" * 64, "-" * 64


def text_reports(
    results: DataFrame, failures: DataFrame | None = None, generated: Column | None = None
) -> DataFrame:
    """``file, report`` text: header, checks, functions with up to three failures each,
    and up to ten property violations."""
    made = F.current_timestamp() if generated is None else generated

    def header(title: str) -> Column:
        return F.array(F.lit(""), F.lit(THIN), F.lit("  " + title), F.lit(THIN))

    icon = lambda ok: F.when(ok, F.lit("✓")).otherwise(F.lit("✗"))
    check_rows = F.transform("checks", lambda c: F.concat(
        F.lit("  "), icon(c["passed"]), F.lit("  "), F.format_string("%-22s", c["check"]), F.lit("  │  "),
        cut(c["message"], 120)))
    nothing = F.array().cast("array<string>")
    functions = nothing
    if "function_results" in results.columns:
        def one(e: Column) -> Column:
            v = e["value"]
            line = F.concat(
                F.lit("  "), icon(v["pass_rate"] == 1.0), F.lit("  "), F.format_string("%-30s", e["key"]), F.lit("  "),
                v["passed"].cast("string"), F.lit("/"), v["total"].cast("string"), F.lit(" ("), percent(v["pass_rate"]), F.lit(")"))
            shown = F.transform(F.slice(v["failures"], 1, 3), lambda f: F.concat(F.lit("       ↳ "), F.left(f, F.lit(100))))
            return F.concat(F.array(line), shown)
        lines = F.flatten(F.transform(F.map_entries("function_results"), one))
        functions = F.when(F.size("function_results") > 0, F.concat(header("PER-FUNCTION BREAKDOWN"), lines)).otherwise(nothing)
    rows, violations = results, nothing
    if failures is not None:
        first = Window.partitionBy("file").orderBy("func", "case_id", "property")
        top = (
            failures.withColumn("_n", F.row_number().over(first)).filter("_n <= 10")
            .groupBy("file").agg(F.sort_array(F.collect_list(F.struct("_n", F.concat(
                F.lit("  ✗  ["), "property", F.lit("] "), "func", F.lit(": "), F.left("message", F.lit(100))).alias("t")))).alias("_p"))
        )
        rows = results.join(top, "file", "left")
        violations = F.when(F.col("_p").isNotNull(), F.concat(
            header("PROPERTY VIOLATIONS"), F.transform("_p", lambda x: x["t"]))).otherwise(nothing)
    head = F.array(
        F.lit(RULE), F.lit("  CODE VALIDATION REPORT"), F.concat(F.lit("  File      : "), F.coalesce("file", F.lit("—"))),
        F.concat(F.lit("  Generated : "), F.date_format(made, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")), F.lit(RULE),
        F.concat(F.lit("\n  Overall Status : "), F.when(F.col("passed"), F.lit("✓ PASS")).otherwise(F.lit("✗ FAIL"))),
        F.concat(F.lit("  Severity       : "), F.upper("severity")),
    )
    rate = F.when(F.col("pass_rate").isNotNull(), F.array(
        F.concat(F.lit("  Pass Rate      : "), percent(F.col("pass_rate"), 1)))).otherwise(nothing)
    body = F.concat(head, rate, header("CHECK RESULTS"), check_rows, functions, violations, F.array(F.lit(""), F.lit(RULE)))
    return rows.select("file", F.array_join(body, "\n").alias("report"))


def console_line(results: DataFrame) -> DataFrame:
    """One summary line per result."""
    ok = F.col("passed")
    failed = F.when(F.col("failed_checks") != "", F.concat(F.lit("  (failed: "), "failed_checks", F.lit(")"))).otherwise(F.lit(""))
    rate = F.when(F.col("pass_rate").isNotNull(), F.concat(F.lit("  pass_rate="), percent(F.col("pass_rate"), 1))).otherwise(F.lit(""))
    return results.select("file", F.concat(
        F.when(ok, F.lit("✓ Validation PASSED [")).otherwise(F.lit("✗ Validation FAILED [")),
        F.upper("severity"), F.lit("]"), rate, failed).alias("line"))
