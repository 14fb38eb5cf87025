"""Behaviour comparison from recorded runs: replay verdicts, properties, aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from patchloom.functions.compare import error_class, results_match
from patchloom.functions.text import cut, fill

# Caps, widths and message texts.
MAX_FAILURES = 5
REPLAY_WIDTH = 80
PROPERTY_WIDTH = 60
MISSING_FUNCTION = "Function '{func}' missing in refactored module — was it renamed or removed?"
UNEQUAL = "args={args}: expected='{old}', got='{new}'"
OTHER_ERROR = "args={args}: orig raised '{old}', refactored raised '{new}'"
DIVERGED = "args={args}: {side} returned normally, other raised — refactored error: {error}"
NONDETERMINISTIC = "Non-deterministic: args={args} → '{new}' ≠ '{again}'"
TYPE_CHANGED = "Return-type changed: orig={old}, refactored={new} for args={args}"
ERROR_CHANGED = "Exception type changed: orig='{old}', refactored='{new}' for args={args}"
ERROR_LOST = "Original raised '{old}' but refactored succeeded for args={args}"
NOT_IDEMPOTENT = "Original is idempotent but refactored is not for args={args}"
# Own text, for a case without a second run.
NO_RUN = "args={args}: no refactored run recorded"

CASE = ["file", "func", "case_id"]
RUN = ["ok", "result", "result_num", "result_type", "error"]
SIDES = {"original": "old", "refactored": "new", "repeat": "again"}


def pair_runs(runs: DataFrame) -> DataFrame:
    """``file, func, case_id, args, old, new, again`` from runs with ``side`` (original, refactored, repeat).

    One grouping on the case key pairs all sides; a case has one row per side, so no
    key is hot. ``repeat`` is a second run of the refactored side. Rows are dealt out before
    they are sorted for it: a large split would be sorted whole, though it merges little.
    """
    run = F.struct(*RUN)
    return runs.repartition(*CASE).groupBy(*CASE).agg(
        F.max("args").alias("args"),
        *[F.max(F.when(F.col("side") == side, run)).alias(out) for side, out in SIDES.items()],
    )


def _matches(a: str, b: str, nested: bool) -> Column:
    return results_match(
        F.col(f"{a}.result_type"), F.col(f"{a}.result"), F.col(f"{a}.result_num"),
        F.col(f"{b}.result_type"), F.col(f"{b}.result"), F.col(f"{b}.result_num"), nested,
    )


def _shown(side: str, width: int) -> Column:
    return cut(F.coalesce(F.col(f"{side}.result"), F.lit("None")), width)


def verdicts(cases: DataFrame, nested: bool = True) -> DataFrame:
    """Adds ``passed`` and ``failure`` to paired cases that the original ran."""
    args = cut(F.col("args"), REPLAY_WIDTH)
    old_class, new_class = error_class(F.col("old.error")), error_class(F.col("new.error"))
    both_ok = F.col("old.ok") & F.col("new.ok")
    both_raised = ~F.col("old.ok") & ~F.col("new.ok")
    rows = cases.filter(F.col("old").isNotNull()).withColumn("_equal", _matches("old", "new", nested))
    passed = (
        F.when(F.col("new").isNull(), F.lit(False))
        .when(both_ok, F.col("_equal"))
        .when(both_raised, old_class == new_class)
        .otherwise(F.lit(False))
    )
    side = F.when(F.col("old.ok"), F.lit("original")).otherwise(F.lit("refactored"))
    error = F.when(F.col("new.ok"), F.lit("no error")).otherwise(F.coalesce("new.error", F.lit("None")))
    failure = (
        F.when(F.col("new").isNull(), fill(NO_RUN, {"args": args}))
        .when(both_ok, fill(UNEQUAL, {"args": args, "old": _shown("old", REPLAY_WIDTH), "new": _shown("new", REPLAY_WIDTH)}))
        .when(both_raised, fill(OTHER_ERROR, {"args": args, "old": old_class, "new": new_class}))
        .otherwise(fill(DIVERGED, {"args": args, "side": side, "error": error}))
    )
    return rows.withColumn("passed", passed).withColumn("failure", F.when(~F.col("passed"), failure)).drop("_equal")


def by_function(judged: DataFrame) -> DataFrame:
    """``file, func, total, passed, pass_rate, ok, failures`` with at most five failures by case.

    A function the refactored side never ran scores zero with one message. The cap is
    a rank limit, which each task applies before the shuffle.
    """
    counts = judged.groupBy("file", "func").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("hits"),
        F.count_if(F.col("new").isNotNull()).alias("ran"),
    )
    first = Window.partitionBy("file", "func").orderBy("case_id")
    failures = (
        judged.filter(~F.col("passed")).select("file", "func", "case_id", "failure")
        .withColumn("n", F.row_number().over(first)).filter(F.col("n") <= MAX_FAILURES)
        .groupBy("file", "func")
        .agg(F.sort_array(F.collect_list(F.struct("n", "failure"))).alias("_failed"))
    )
    missing = F.array(fill(MISSING_FUNCTION, {"func": F.col("func")}))
    hits = F.when(F.col("ran") > 0, F.col("hits")).otherwise(F.lit(0))
    return counts.join(failures, ["file", "func"], "left").select(
        "file", "func", "total", hits.alias("passed"),
        F.when(F.col("total") > 0, hits / F.col("total")).otherwise(F.lit(0.0)).alias("pass_rate"),
        (hits == F.col("total")).alias("ok"),
        F.when(F.col("ran") == 0, missing).otherwise(
            F.coalesce(F.transform("_failed", lambda x: x["failure"]), F.array().cast("array<string>"))
        ).alias("failures"),
    )


def of_shared(rows: DataFrame, shared: DataFrame | None) -> DataFrame:
    """Rows of functions that ``shared(file, func)`` holds; all where it is not given."""
    return rows if shared is None else rows.join(shared, ["file", "func"], "left_semi")


def properties(cases: DataFrame, nested: bool = True, shared: DataFrame | None = None) -> DataFrame:
    """``file, func, case_id, property, passed, message`` for determinism, type stability
    and the exception contract. Functions must have runs on both sides, and be public on
    both where ``shared(file, func)`` says which are."""
    args = cut(F.col("args"), PROPERTY_WIDTH)
    old_class, new_class = error_class(F.col("old.error")), error_class(F.col("new.error"))
    rows = of_shared(cases, shared).withColumn("_steady", _matches("new", "again", nested))
    both = F.col("old").isNotNull() & F.col("new").isNotNull()

    def item(name: str, passed: Column, message: Column) -> Column:
        return F.struct(
            F.lit(name).alias("property"), passed.alias("passed"),
            F.when(passed, F.lit("")).otherwise(message).alias("message"),
        )

    determinism = F.when(
        F.col("new.ok") & F.col("again.ok"),
        item("determinism", F.col("_steady"), fill(NONDETERMINISTIC, {
            "args": args, "new": _shown("new", PROPERTY_WIDTH), "again": _shown("again", PROPERTY_WIDTH)})),
    )
    stability = F.when(
        both & F.col("old.ok") & F.col("new.ok"),
        item("type_stability", F.col("old.result_type") == F.col("new.result_type"), fill(TYPE_CHANGED, {
            "args": args, "old": F.col("old.result_type"), "new": F.col("new.result_type")})),
    )
    lost = fill(ERROR_LOST, {"args": args, "old": old_class})
    changed = fill(ERROR_CHANGED, {"args": args, "old": old_class, "new": new_class})
    contract = F.when(
        both & ~F.col("old.ok"),
        item("exception_contract", ~F.col("new.ok") & (old_class == new_class), F.when(F.col("new.ok"), lost).otherwise(changed)),
    )
    checks = F.array_compact(F.array(determinism, stability, contract))
    return rows.filter(both).select("file", "func", "case_id", F.inline(checks))


def idempotence(runs: DataFrame, nested: bool = True, shared: DataFrame | None = None) -> DataFrame:
    """``file, func, case_id, property, passed, message``; only cases where the original is idempotent.

    The second call is the recorded run whose arguments are the first call's result.
    Both sides of that lookup are reduced to distinct keys before they meet.
    """
    key = ["file", "func", "side"]
    # no key where there is no value, so that a null result meets no call
    text = lambda column: F.when(column.isNotNull(), F.concat_ws("\u0001", *[F.coalesce(F.col(k), F.lit("\u0002")) for k in key], column))
    # small portions before the sort that ``second`` begins with, as in ``pair_runs``
    ran = of_shared(runs.filter(F.col("side").isin("original", "refactored")), shared).repartition(*CASE)
    as_args = F.when(F.col("result_type") == "tuple", F.col("result")).otherwise(
        F.concat(F.lit("["), "result", F.lit("]"))
    )
    first = ran.filter(F.col("ok")).withColumn("_k", text(as_args))
    second = (
        ran.withColumn("_k", text(F.col("args"))).filter("_k IS NOT NULL")
        .groupBy("_k").agg(F.max(F.struct(*RUN)).alias("then"))
    )
    met = first.select(*key, "case_id", "args", F.struct(*RUN).alias("was"), "_k").join(second, "_k", "left")
    same = _matches("was", "then", nested)
    steady = met.withColumn("_same", same).withColumn(
        "steady", F.when(F.col("then").isNull(), F.lit(None)).otherwise(F.col("then.ok") & F.col("_same"))
    )
    wide = steady.groupBy("file", "func", "case_id").agg(
        F.max("args").alias("args"),
        F.max(F.when(F.col("side") == "original", F.col("steady"))).alias("old"),
        F.max(F.when(F.col("side") == "refactored", F.col("steady"))).alias("new"),
    )
    return wide.filter(F.col("old") & F.col("new").isNotNull()).select(
        "file", "func", "case_id", F.lit("idempotence").alias("property"), F.col("new").alias("passed"),
        F.when(F.col("new"), F.lit("")).otherwise(
            fill(NOT_IDEMPOTENT, {"args": cut(F.col("args"), PROPERTY_WIDTH)})
        ).alias("message"),
    )


def shared_functions(units: DataFrame) -> DataFrame:
    """``file, func`` public on both sides, from units with ``side``."""
    return (
        units.groupBy("file", F.col("name").alias("func"))
        .agg(F.count_if(F.col("side") == "original").alias("a"), F.count_if(F.col("side") == "refactored").alias("b"))
        .filter("a > 0 AND b > 0").select("file", "func")
    )


def aggregate(functions: DataFrame, failures: DataFrame) -> DataFrame:
    """``file, total_tests, passed_tests, pass_rate, function_results, n_property_failures``.

    ``failures`` are failed property rows. The map has one entry per function. A file
    without replay cases gets a null rate; its property failures still count.
    """
    per_file = functions.groupBy("file").agg(
        F.sum("total").alias("total_tests"), F.sum("passed").alias("passed_tests"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(
            "func", F.struct("total", "passed", "pass_rate", "failures").alias("v"))))).alias("function_results"),
    )
    broken = failures.groupBy("file").agg(F.count(F.lit(1)).alias("n_property_failures"))
    zero = F.lit(0).cast("long")
    return per_file.join(broken, "file", "full_outer").select(
        "file", F.coalesce("total_tests", zero).alias("total_tests"),
        F.coalesce("passed_tests", zero).alias("passed_tests"),
        F.when(F.col("total_tests") > 0, F.col("passed_tests") / F.col("total_tests")).alias("pass_rate"),
        "function_results", F.coalesce("n_property_failures", zero).alias("n_property_failures"),
    )
