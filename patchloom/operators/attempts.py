"""Retry selection, attempt merging, run summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from patchloom.functions.text import cut, percent

NONE = "—"
ERROR_WIDTH = 40


def stage_error(stage1: Column, stage2: Column, stage3: Column) -> Column:
    """Why a file never reached validation."""
    return (
        F.when(~stage1, F.lit("Stage 1 failed"))
        .when(~stage2, F.lit("Stage 2 failed"))
        .when(~stage3, F.lit("Stage 3 failed"))
        .otherwise(F.lit("No refactored file produced"))
    )


def gate_stages(stages: DataFrame) -> DataFrame:
    """Make later stages false once one failed; ``stage1_ok, stage2_ok, stage3_ok``."""
    one = F.coalesce("stage1_ok", F.lit(False))
    two = one & F.coalesce("stage2_ok", F.lit(False))
    three = two & F.coalesce("stage3_ok", F.lit(False))
    return stages.withColumns({"stage1_ok": one, "stage2_ok": two, "stage3_ok": three})


def validation_error(first_check: Column, message: Column) -> Column:
    """``[check] message`` cut to 55 characters; ``—`` when nothing failed."""
    return F.when(
        first_check.isNotNull(), F.concat(F.lit("["), first_check, F.lit("] "), cut(message, 55))
    ).otherwise(F.lit(NONE))


def to_retry(results: DataFrame, retry_unvalidated: bool = False) -> DataFrame:
    """Files validated and failed; with the option also those that never got there."""
    failed = F.coalesce(~F.col("val_passed"), F.lit(retry_unvalidated))
    return results.filter(failed)


def merge_attempts(first: DataFrame, retried: DataFrame) -> DataFrame:
    """Final rows from ``first(file, val_passed, val_severity, val_pass_rate, val_error)`` and
    ``retried(file, retry_val_passed, retry_severity, retry_error)``; one row per file on both sides."""
    joined = first.join(retried.withColumn("retried", F.lit(True)), "file", "left").withColumn(
        "retried", F.coalesce("retried", F.lit(False))
    )
    return joined.withColumn("final_status", final_status()).withColumn("error", shown_error())


def final_status() -> Column:
    word = lambda ok: F.when(ok, F.lit("PASS")).otherwise(F.lit("FAIL"))
    return (
        F.when(F.col("retried") & F.col("retry_val_passed").isNotNull(), word(F.col("retry_val_passed")))
        .when(F.col("val_passed").isNull(), F.lit("SKIP"))
        .otherwise(word(F.col("val_passed")))
    )


def shown_error() -> Column:
    """The retry's error replaces the first one when it says anything."""
    again = F.when(F.col("retried"), F.nullif(F.nullif(F.col("retry_error"), F.lit("")), F.lit(NONE)))
    return F.coalesce(again, F.col("val_error"))


def summary_rows(merged: DataFrame) -> DataFrame:
    """Display columns of the run table."""
    icon = lambda ok: (
        F.when(ok, F.lit("✓ PASS")).when(~ok, F.lit("✗ FAIL")).otherwise(F.lit("— SKIP"))
    )
    return merged.select(
        "file", icon(F.col("val_passed")).alias("validation"), F.coalesce("val_severity", F.lit(NONE)).alias("severity"),
        percent(F.col("val_pass_rate")).alias("pass_rate"),
        F.when(F.col("retried"), icon(F.col("retry_val_passed"))).otherwise(F.lit(NONE)).alias("after_retry"),
        cut(F.coalesce("error", F.lit(NONE)), ERROR_WIDTH, ERROR_WIDTH - 1).alias("notes"),
    )


def run_summary(merged: DataFrame) -> DataFrame:
    """``total, passed, failed, skipped, retried, recovered, all_pass``."""
    state = F.col("final_status")
    return merged.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(state == "PASS").alias("passed"),
        F.count_if(state == "FAIL").alias("failed"), F.count_if(state == "SKIP").alias("skipped"),
        F.count_if("retried").alias("retried"),
        F.count_if(F.col("retried") & F.coalesce("retry_val_passed", F.lit(False))).alias("recovered"),
        F.bool_and(state == "PASS").alias("all_pass"),
    )
