"""Jobs from event lines: stages, durations, status, timeouts, lists, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from patchloom import config
from patchloom.functions.text import let, strip
from patchloom.skew import scan_within

TERMINAL = ["completed", "failed", "cancelled"]
NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*\z"
LOG_PART_LINES = 10_000


def parse_markers(lines: DataFrame) -> DataFrame:
    """Stage markers of ``job_id, ts, line``: adds ``stage DOUBLE`` and ``stage_label``.

    Works on batch and streaming input. Lines without a readable number are ignored.
    """
    labels = F.create_map(*[F.lit(v) for pair in config.STAGE_LABELS for v in pair])

    def marker(parts: Column) -> Column:
        number = F.get(parts, F.lit(2))
        stage = F.when(number.rlike(NUMBER), F.trim(number).try_cast("double"))
        # int() of a stage cuts towards zero
        whole = lambda n: F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("int")
        return let(stage, lambda n: F.struct(
            n.alias("stage"),
            F.coalesce(F.get(parts, F.lit(3)), F.try_element_at(labels, whole(n)), F.lit(config.UNKNOWN_STAGE_LABEL)).alias("stage_label"),
        ))

    # one generator instead of a filter over derived columns: each line is taken apart once
    read = F.transform(F.array(F.split(strip(F.col("line")), "::")), marker)
    rest = [c for c in lines.columns if c != "line"]
    return lines.filter(F.contains("line", F.lit(config.STAGE_MARKER))).select(
        *rest, F.inline(F.filter(read, lambda m: m["stage"].isNotNull()))
    )


def stage_times(markers: DataFrame) -> DataFrame:
    """``job_id, stage, ts``: a repeated stage keeps its last time."""
    return markers.groupBy("job_id", "stage").agg(F.max("ts").alias("ts"))


def stage_time_map(markers: DataFrame) -> DataFrame:
    """One map per job; its size is the number of distinct stages."""
    return stage_times(markers).groupBy("job_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("stage", "ts")))).alias("stage_times")
    )


def whole_stage_times(times: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """``job_id, t1..t5`` in microseconds, the earliest time per whole stage.

    ``done(job_id, ts)`` rows are stage 5, the last one counting. All five are
    conditional aggregates of one grouping, so no window is needed.
    """
    rows = times.select("job_id", F.floor("stage").cast("int").alias("n"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    if done is not None:
        rows = rows.filter("n <> 5").unionByName(
            done.select("job_id", F.lit(5).alias("n"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
        )
    return rows.groupBy("job_id").agg(
        *[F.min(F.when(F.col("n") == n, F.col("us"))).alias(f"t{n}") for n in range(1, 5)],
        F.max(F.when(F.col("n") == 5, F.col("us"))).alias("t5"),
    )


def backfill(wide: DataFrame) -> DataFrame:
    """Fill missing stages 2..4 evenly between 1 and 5, never before the stage ahead."""
    start, total = F.col("t1"), F.col("t5") - F.col("t1")
    both = F.col("t1").isNotNull() & F.col("t5").isNotNull()
    filled = wide
    for n in (2, 3, 4):
        even = start + F.floor(total * (n - 1) / 4)
        filled = filled.withColumn(
            f"t{n}", F.when(F.col(f"t{n}").isNull() & both, F.greatest(even, F.col(f"t{n - 1}"))).otherwise(F.col(f"t{n}"))
        )
    return filled


def _seconds(start: Column, end: Column) -> Column:
    """Whole seconds between two microsecond times, halves up, on millisecond clocks."""
    milliseconds = F.floor(end / 1000) - F.floor(start / 1000)
    return F.floor((milliseconds + 500) / 1000)


def durations(wide: DataFrame) -> DataFrame:
    """``job_id, stage_1_s..stage_4_s, total_s`` and the clamped ``tag_1_s..tag_4_s``."""
    steps = {n: _seconds(F.col(f"t{n}"), F.col(f"t{n + 1}")) for n in range(1, 5)}
    return wide.select(
        "job_id",
        *[s.alias(f"stage_{n}_s") for n, s in steps.items()],
        *[F.when(s.isNotNull(), F.greatest(s, F.lit(0))).alias(f"tag_{n}_s") for n, s in steps.items()],
        _seconds(F.col("t1"), F.col("t5")).alias("total_s"),
    )


def current_stage(markers: DataFrame) -> DataFrame:
    """``job_id, stage, stage_label, updated_at`` of the latest marker."""
    # the hash aggregate leaves a few rows per job for the ordered one
    few = markers.groupBy("job_id", "stage", "stage_label").agg(F.max("ts").alias("ts"))
    last = F.max(F.struct("ts", "stage", "stage_label"))
    return few.groupBy("job_id").agg(last.alias("m")).select(
        "job_id", "m.stage", "m.stage_label", F.col("m.ts").alias("updated_at")
    )


def job_status(events: DataFrame) -> DataFrame:
    """``job_id, status, created_at, updated_at, started_at, seen_at`` from ``job_id, ts, status``.

    The first terminal status stays; otherwise the latest status counts.
    """
    few = events.groupBy("job_id", "status").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return few.groupBy("job_id").agg(
        F.min(F.when(F.col("status").isin(TERMINAL), F.struct(F.col("first").alias("ts"), "status"))).alias("_end"),
        F.max(F.struct(F.col("last").alias("ts"), "status")).alias("_last"), F.min("first").alias("created_at"), F.max("last").alias("seen_at"),
        F.min(F.when(F.col("status") == "running", F.col("first"))).alias("started_at"),
    ).select(
        "job_id", F.coalesce("_end.status", "_last.status").alias("status"), "created_at",
        F.coalesce("_end.ts", "_last.ts").alias("updated_at"), "started_at", "seen_at",
    )


def final_stage(jobs: DataFrame) -> DataFrame:
    """``stage`` and ``stage_label`` as they stand at the end, from ``status``, ``error`` and the
    latest marker: done where the run ended by itself, idle where it was stopped by an
    error or the time limit; a cancelled job stays where it was."""
    ended = F.col("status").isin("completed", "failed")
    stopped = (F.col("status") == "failed") & F.col("error").isNotNull()
    return jobs.withColumns({
        "stage": F.when(stopped, F.lit(0.0)).when(ended, F.lit(5.0)).otherwise(F.col("stage")),
        "stage_label": F.when(stopped, F.lit("idle")).when(ended, F.lit("done")).when(
            F.col("status") == "cancelled", F.lit("cancelled")).otherwise(F.col("stage_label")),
    })


def exit_status(code: Column) -> Column:
    return F.when(code == 0, F.lit("completed")).otherwise(F.lit("failed"))


def step_state(stage: Column, n: int) -> Column:
    return F.when(stage > n, F.lit("completed")).when(stage == n, F.lit("active")).otherwise(F.lit("pending"))


def timeouts(jobs: DataFrame, limit_s: int = config.JOB_TIME_LIMIT_S) -> DataFrame:
    """Running jobs past the limit become failed. Rows: ``job_id, status, started_at, seen_at``."""
    late = (F.col("status") == "running") & (
        F.unix_micros(F.col("seen_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
        > limit_s * 1_000_000
    )
    return jobs.withColumn("timed_out", F.coalesce(late, F.lit(False))).withColumn(
        "error", F.when(F.col("timed_out"), F.lit(config.TIMEOUT_MESSAGE))
    ).withColumn("status", F.when(F.col("timed_out"), F.lit("failed")).otherwise(F.col("status")))


def job_labels(files: DataFrame) -> DataFrame:
    """``job_id, filename``: names joined in upload order.

    ``files`` carry ``job_id, ord, name``. Repeats of a name are folded first, so the
    label is as long as the names in one upload request.
    """
    names = files.groupBy("job_id", "name").agg(F.min("ord").alias("ord"))
    return names.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("ord", "name"))).alias("_n")).select(
        "job_id", F.array_join(F.transform("_n", lambda x: x["name"]), ", ").alias("filename")
    )


def newest_first(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.col("created_at").desc(), "job_id")


def finished(jobs: DataFrame) -> DataFrame:
    """Only jobs whose results may be read."""
    return jobs.filter(~F.col("status").isin("queued", "running"))


def job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("status") == "running").alias("running")
    )


def job_key(*parts: Column) -> Column:
    """Stable id from what identifies a job."""
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def job_logs(lines: DataFrame, part_lines: int = LOG_PART_LINES) -> DataFrame:
    """``job_id, part, lines, log``: text in arrival order, at most ``part_lines`` lines a row.

    Reading the parts of a job in order gives its whole log; a short log is one row.
    """
    ranked = scan_within(lines, ["job_id"], [F.col("ts"), F.col("seq")], rank="_n")
    parts = ranked.withColumn("part", F.floor((F.col("_n") - 1) / part_lines).cast("int"))
    return parts.groupBy("job_id", "part").agg(
        F.count(F.lit(1)).alias("lines"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "line"))), lambda x: x["line"]), "").alias("log"),
    )


def artefacts(originals: DataFrame, rewritten: DataFrame, reports: DataFrame) -> DataFrame:
    """``file, ord, original_code, refactored_code, validation_report``; absent parts stay null.

    All three inputs have one row per file.
    """
    return (
        originals.select("file", "ord", F.col("content").alias("original_code"))
        .join(rewritten.select("file", F.col("content").alias("refactored_code")), "file", "left")
        .join(reports.select("file", F.col("report").alias("validation_report")), "file", "left")
    )


def primary_result(rows: DataFrame) -> DataFrame:
    """``job_id, file, refactored_code, validation_report`` of the first file with code."""
    has = F.coalesce(F.col("refactored_code") != "", F.lit(False))
    first = F.min_by(F.struct("file", "refactored_code", "validation_report"), F.col("ord"))
    return rows.filter(has).groupBy("job_id").agg(first.alias("p")).select("job_id", "p.*")
