"""Attempts in rounds: every file once, then only the files that failed, each with what went wrong.

A round takes the failed files of the round before, nothing else: their prompts get the
failures as context, replies are spliced into the originals, and the outcome is validated.
Each round is cut from its lineage as one table of attempts; the newest row per file
counts. Rounds end when nothing failed, when no rewritten text changed, or after ``most``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from patchloom.operators import attempts
from patchloom.plans import flow
from patchloom.session import cut_lineage, dropped

# Own text, for a file that gave nothing when it was tried again.
NOT_AGAIN = "Stage 3 failed on retry"
Answer = Callable[[DataFrame, int], DataFrame]


@dataclass
class Rounds:
    """``attempts(file, attempt, passed, severity, pass_rate, error, changed)``, the newest text of each
    file, and ``merged``: final rows as ``attempts.merge_attempts`` gives them."""

    attempts: DataFrame
    files: DataFrame
    merged: DataFrame
    rounds: int


def from_table(replies: DataFrame) -> Answer:
    """Replies of ``attempt, file, prompt_id, reply`` for the prompts that were sent."""
    def answer(prompts: DataFrame, attempt: int) -> DataFrame:
        sent = prompts.select("file", "prompt_id")
        return replies.filter(F.col("attempt") == attempt).drop("attempt").join(sent, ["file", "prompt_id"], "left_semi")
    return answer


def run_rounds(
    files: DataFrame, examples: DataFrame, answer: Answer, most: int = 2, batch_size: int = 1,
    runs: Callable[[int], DataFrame] | None = None, **options,
) -> Rounds:
    """``answer`` gives ``file, prompt_id, reply`` for the prompts of a round; ``runs`` its recorded
    executions. ``options`` go to the validation. The prompts of a retry are there until it is spliced."""
    chunked = flow.chunk_corpus(files)
    chunks = cut_lineage(chunked.chunks)
    prompts = cut_lineage(flow.build_prompts(chunks, files, examples, batch_size))
    # of the chunks, only their files are asked for again
    reached = cut_lineage(chunks.select("file").distinct())
    dropped(chunks)
    tried, sent, before, rows = files, prompts, None, []
    results = failures = None
    for attempt in range(1, most + 1):
        if attempt > 1:
            failed = results.filter("NOT passed").select("file")
            if failed.isEmpty():
                break
            tried = files.join(failed, "file", "left_semi")
            sent = cut_lineage(flow.retry_prompts(prompts, results, failures))
        made = flow.apply_replies(tried, sent, answer(sent, attempt)).files
        # texts of this round, and whether they differ from the round before
        if before is not None:
            # a digest stands for the text of before, which need not travel
            made = made.join(before.select("file", F.sha2("content", 256).alias("_was")), "file", "left").select(
                "file", "content", "applied", F.coalesce(F.sha2("content", 256) != F.col("_was"), F.lit(True)).alias("changed"))
        else:
            made = made.withColumn("changed", F.lit(True))
        # what is left out is left out of the written rows: a filter in the same plan would splice every file twice
        made = cut_lineage(made).filter("applied > 0").drop("applied")
        if attempt > 1:
            dropped(sent)
        checked = flow.validate_detail(tried, made.drop("changed"), runs(attempt) if runs else None, attempt=attempt, known=chunked.parsed, **options)
        results = cut_lineage(checked.results)
        failures = checked.failures
        rows.append(results.select("file", "attempt", "passed", "severity", "pass_rate", "checks").join(made.select("file", "changed"), "file", "left"))
        before = made.drop("changed") if before is None else _newest(before, made.drop("changed"))
        if attempt > 1 and made.filter("changed").isEmpty():
            break
    first = _first_rows(rows[0], reached, prompts)
    again = [_again_rows(r) for r in rows[1:]]
    retried = again[0] if again else _again_rows(rows[0]).limit(0)
    for later in again[1:]:
        retried = later.unionByName(retried.join(later, "file", "left_anti"))
    listed = None
    for row in rows:
        bad = F.get(F.filter("checks", lambda c: ~c["passed"]), F.lit(0))
        one = row.select("file", "attempt", "passed", "severity", "pass_rate",
                         attempts.validation_error(bad["check"], bad["message"]).alias("error"), F.coalesce("changed", F.lit(False)).alias("changed"))
        listed = one if listed is None else listed.unionByName(one)
    return Rounds(listed, before, attempts.merge_attempts(first, retried), len(rows))


def _newest(before: DataFrame, made: DataFrame) -> DataFrame:
    return made.unionByName(before.join(made.select("file"), "file", "left_anti"))


def _first_rows(results: DataFrame, chunks: DataFrame, prompts: DataFrame) -> DataFrame:
    """The first attempt's rows; a file that never reached validation says where it stopped."""
    reached = results.join(chunks.select("file").distinct().withColumn("stage1_ok", F.lit(True)), "file", "left").join(
        prompts.select("file").distinct().withColumn("stage2_ok", F.lit(True)), "file", "left")
    gated = attempts.gate_stages(reached.withColumn("stage3_ok", F.col("passed").isNotNull()))
    row = flow.attempt_row(gated)
    stopped = gated.filter("passed IS NULL").select(
        "file", attempts.stage_error(F.col("stage1_ok"), F.col("stage2_ok"), F.col("stage3_ok")).alias("_why"))
    return row.join(stopped, "file", "left").withColumn("val_error", F.coalesce("_why", "val_error")).drop("_why")


def _again_rows(results: DataFrame) -> DataFrame:
    """A later attempt's rows; a file that gave nothing has failed."""
    row = flow.attempt_row(results)
    return row.select(
        "file", F.coalesce("val_passed", F.lit(False)).alias("retry_val_passed"),
        F.when(F.col("val_passed").isNull(), F.lit("error")).otherwise(F.col("val_severity")).alias("retry_severity"),
        F.when(F.col("val_passed").isNull(), F.lit(NOT_AGAIN)).otherwise(F.col("val_error")).alias("retry_error"))
