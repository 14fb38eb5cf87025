"""Queries over stage events and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom.operators import jobs
from patchloom.plans import derive
from patchloom.plans.registry import query, read
from patchloom.session import work_path
from patchloom.streaming import job_stream, log_source, stage_stream


def _event_stream(spark, sf_dir):
    """The event table as a stream; its times mean UTC."""
    schema = read(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


MARKERS = """
lines AS (
  SELECT event_id // 4 AS job_id, ts, event_id,
         CASE WHEN event_id % 50 = 49 THEN NULL
              ELSE CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 2.0 WHEN 'signup' THEN 3.0
                   WHEN 'error' THEN 3.5 ELSE 4.0 END END::DOUBLE AS stage,
         CASE WHEN event_id % 2 = 0 THEN event_type
              ELSE CASE event_type WHEN 'view' THEN 'cAST' WHEN 'click' THEN 'prompt_builder'
                   WHEN 'signup' THEN 'llm_agent' WHEN 'error' THEN 'llm_agent' ELSE 'validator' END END AS stage_label
  FROM events),
markers AS (SELECT * FROM lines WHERE stage IS NOT NULL)"""

WIDE = MARKERS + """,
times AS (SELECT job_id, stage, max(ts) AS ts FROM markers GROUP BY 1, 2),
done AS (SELECT event_id // 4 AS job_id, max(epoch_us(ts) + CAST(floor(value * 1000) AS BIGINT) * 1000) AS us
         FROM events GROUP BY 1),
whole AS (
  SELECT job_id, min(us) FILTER (n = 1) AS t1, min(us) FILTER (n = 2) AS t2, min(us) FILTER (n = 3) AS t3,
         min(us) FILTER (n = 4) AS t4, min(us) FILTER (n = 5) AS t5
  FROM (SELECT job_id, CAST(floor(stage) AS INT) AS n, epoch_us(ts) AS us FROM times
        UNION ALL SELECT job_id, 5, us FROM done) GROUP BY 1),
f2 AS (SELECT job_id, t1, coalesce(t2, greatest(t1 + (t5 - t1) // 4, t1)) AS t2, t3, t4, t5, t1 IS NULL AS no1, t2 AS r2 FROM whole),
f3 AS (SELECT job_id, t1, CASE WHEN no1 THEN r2 ELSE t2 END AS t2, t3, t4, t5, no1 FROM f2),
f4 AS (SELECT job_id, t1, t2, CASE WHEN t3 IS NULL AND NOT no1 THEN greatest(t1 + (2 * (t5 - t1)) // 4, t2) ELSE t3 END AS t3, t4, t5, no1 FROM f3),
filled AS (SELECT job_id, t1, t2, t3, CASE WHEN t4 IS NULL AND NOT no1 THEN greatest(t1 + (3 * (t5 - t1)) // 4, t3) ELSE t4 END AS t4, t5 FROM f4),
ms AS (SELECT job_id, t1 // 1000 AS m1, t2 // 1000 AS m2, t3 // 1000 AS m3, t4 // 1000 AS m4, t5 // 1000 AS m5 FROM filled)"""


@query("stage_durations", f"""
WITH {WIDE}
SELECT job_id,
  CAST(floor((m2 - m1 + 500) / 1000) AS BIGINT) AS stage_1_s, CAST(floor((m3 - m2 + 500) / 1000) AS BIGINT) AS stage_2_s,
  CAST(floor((m4 - m3 + 500) / 1000) AS BIGINT) AS stage_3_s, CAST(floor((m5 - m4 + 500) / 1000) AS BIGINT) AS stage_4_s,
  CASE WHEN m2 - m1 IS NOT NULL THEN greatest(0, CAST(floor((m2 - m1 + 500) / 1000) AS BIGINT)) END AS tag_1_s,
  CASE WHEN m3 - m2 IS NOT NULL THEN greatest(0, CAST(floor((m3 - m2 + 500) / 1000) AS BIGINT)) END AS tag_2_s,
  CASE WHEN m4 - m3 IS NOT NULL THEN greatest(0, CAST(floor((m4 - m3 + 500) / 1000) AS BIGINT)) END AS tag_3_s,
  CASE WHEN m5 - m4 IS NOT NULL THEN greatest(0, CAST(floor((m5 - m4 + 500) / 1000) AS BIGINT)) END AS tag_4_s,
  CAST(floor((m5 - m1 + 500) / 1000) AS BIGINT) AS total_s
FROM ms""")
def stage_durations(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    times = jobs.stage_times(jobs.parse_markers(derive.stage_lines(events)))
    wide = jobs.whole_stage_times(times, derive.done_times(events))
    return jobs.durations(jobs.backfill(wide))


@query("stage_times", f"""
WITH {MARKERS}
SELECT job_id, stage, epoch_us(max(ts)) AS at_us FROM markers GROUP BY 1, 2""")
def stage_times(spark, sf_dir):
    times = jobs.stage_times(jobs.parse_markers(derive.stage_lines(read(spark, sf_dir, "events"))))
    return times.select("job_id", "stage", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))


@query("stage_time_map", f"""
WITH {MARKERS}, times AS (SELECT job_id, stage, max(ts) AS ts FROM markers GROUP BY 1, 2)
SELECT job_id, string_agg(stage || '=' || epoch_us(ts), ',' ORDER BY stage) AS stages FROM times GROUP BY 1""")
def stage_time_map(spark, sf_dir):
    maps = jobs.stage_time_map(jobs.parse_markers(derive.stage_lines(read(spark, sf_dir, "events"))))
    shown = F.transform(F.array_sort(F.map_entries("stage_times")), lambda e: F.concat(
        e["key"].cast("string"), F.lit("="), F.unix_micros(e["value"].cast("timestamp")).cast("string")))
    return maps.select("job_id", F.array_join(shown, ",").alias("stages"))


@query("exit_statuses", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'completed' ELSE 'failed' END AS status FROM events""")
def exit_statuses(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    return events.select("event_id", jobs.exit_status(F.col("event_id") % 4).alias("status"))


STATUS = """
states AS (
  SELECT event_id // 4 AS job_id, ts, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running'
         WHEN 'signup' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status FROM events),
status AS (
  SELECT job_id, coalesce(
           arg_min(status, ts) FILTER (status IN ('completed', 'failed', 'cancelled')), arg_max(status, ts)) AS status,
         min(ts) AS created_at,
         coalesce(min(ts) FILTER (status IN ('completed', 'failed', 'cancelled')), max(ts)) AS updated_at
  FROM states GROUP BY 1)"""


# Status, stage and steps of every job.
JOB_STATE = f"""
WITH {MARKERS}, {STATUS},
latest AS (SELECT job_id, arg_max(stage, ts) AS stage, arg_max(stage_label, ts) AS stage_label, max(ts) AS marked FROM markers GROUP BY 1),
span AS (SELECT job_id, min(ts) FILTER (status = 'running') AS started_at, max(ts) AS seen_at FROM states GROUP BY 1),
late AS (SELECT s.*, coalesce(s.status = 'running' AND epoch_us(seen_at) - epoch_us(started_at) > 1800000000, false) AS timed_out
         FROM status s JOIN span USING (job_id)),
ended AS (
  SELECT s.job_id, CASE WHEN timed_out THEN 'failed' ELSE s.status END AS status, marked, updated_at,
    CASE WHEN timed_out THEN 0.0 WHEN s.status IN ('completed', 'failed') THEN 5.0 ELSE stage END::DOUBLE AS stage,
    CASE WHEN timed_out THEN 'idle' WHEN s.status IN ('completed', 'failed') THEN 'done' WHEN s.status = 'cancelled' THEN 'cancelled' ELSE stage_label END AS stage_label
  FROM late s LEFT JOIN latest l ON s.job_id = l.job_id)
"""
JOB_STATE_COLUMNS = """
  status, stage, stage_label, epoch_us(marked) AS stage_us, epoch_us(updated_at) AS status_us,
  CASE WHEN stage > 1 THEN 'completed' WHEN stage = 1 THEN 'active' ELSE 'pending' END AS step_1,
  CASE WHEN stage > 2 THEN 'completed' WHEN stage = 2 THEN 'active' ELSE 'pending' END AS step_2,
  CASE WHEN stage > 3 THEN 'completed' WHEN stage = 3 THEN 'active' ELSE 'pending' END AS step_3,
  CASE WHEN stage > 4 THEN 'completed' WHEN stage = 4 THEN 'active' ELSE 'pending' END AS step_4"""


def _state_columns(rows):
    """The columns of a job's state from its status, its latest marker and the times of both."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return jobs.final_stage(rows).select(
        "job_id", "status", "stage", "stage_label", us("stage_at").alias("stage_us"), us("status_at").alias("status_us"),
        *[jobs.step_state(F.col("stage"), n).alias(f"step_{n}") for n in range(1, 5)], *[c for c in rows.columns if c == "overdue"])


@query("job_state_latest", f"{JOB_STATE}SELECT job_id, {JOB_STATE_COLUMNS} FROM ended")
def job_state_latest(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    stage = jobs.current_stage(jobs.parse_markers(derive.stage_lines(events))).withColumnRenamed("updated_at", "stage_at")
    status = jobs.timeouts(jobs.job_status(derive.status_events(events))).withColumnRenamed("updated_at", "status_at")
    return _state_columns(status.join(stage, "job_id", "left"))


@query("stream_job_state", f"""{JOB_STATE},
bounds AS (
  SELECT job_id, epoch_us(min(ts) FILTER (status = 'running')) + 1800000000 AS deadline,
    epoch_us(min(ts) FILTER (status IN ('completed', 'failed', 'cancelled'))) AS end_us FROM states GROUP BY 1),
mark AS (SELECT epoch_us(max(ts)) - 3600000000 AS us FROM events)
SELECT job_id, coalesce(deadline < mark.us AND (end_us IS NULL OR end_us > deadline), false) AS overdue, {JOB_STATE_COLUMNS}
FROM ended JOIN bounds USING (job_id), mark""")
def stream_job_state(spark, sf_dir):
    """The state of every job by way of the stream, and which jobs it reported as past their limit."""
    events = _event_stream(spark, sf_dir)
    changes = job_stream.job_changes(job_stream.job_events(derive.stage_lines(events), derive.status_events(events)))
    feed = job_stream.job_feed(spark, work_path(spark, "jobs"))
    job_stream.keep_jobs(changes, feed, work_path(spark, "jobs-progress"))
    rows = feed.read(job_stream.feed_schema(spark))
    table = job_stream.job_table(rows).withColumnRenamed("updated_at", "status_at")
    marks = rows.select("job_id", job_stream.overdue(rows).alias("overdue"))
    return _state_columns(jobs.timeouts(table).join(marks, "job_id"))


@query("job_timeouts", f"""
WITH {STATUS},
span AS (SELECT job_id, min(ts) FILTER (status = 'running') AS started_at, max(ts) AS seen_at FROM states GROUP BY 1),
late AS (SELECT s.job_id, s.status, coalesce(s.status = 'running' AND epoch_us(seen_at) - epoch_us(started_at) > 1800000000, false) AS timed_out
         FROM status s JOIN span USING (job_id))
SELECT job_id, CASE WHEN timed_out THEN 'failed' ELSE status END AS status, timed_out,
  CASE WHEN timed_out THEN 'Pipeline timed out after 30 minutes. Large projects or API rate limits may be the cause.' END AS error
FROM late""")
def job_timeouts(spark, sf_dir):
    events = derive.status_events(read(spark, sf_dir, "events"))
    rows = jobs.job_status(events)
    return jobs.timeouts(rows).select("job_id", "status", "timed_out", "error")


@query("job_list_newest", f"""
WITH {STATUS},
names AS (SELECT event_id // 4 AS job_id, event_type || '.py' AS name, min(event_id) AS ord FROM events GROUP BY 1, 2),
label AS (SELECT job_id, string_agg(name, ', ' ORDER BY ord) AS filename FROM names GROUP BY 1)
SELECT s.job_id, filename, status, epoch_us(created_at) AS created_us, status NOT IN ('queued', 'running') AS has_results,
  sha256(CAST(s.job_id AS VARCHAR) || chr(1) || filename) AS job_key
FROM status s JOIN label l ON s.job_id = l.job_id""")
def job_list_newest(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    files = events.select(
        F.floor(F.col("event_id") / 4).alias("job_id"), F.col("event_id").alias("ord"),
        F.concat("event_type", F.lit(".py")).alias("name"),
    )
    rows = jobs.job_status(derive.status_events(events)).join(jobs.job_labels(files), "job_id")
    return jobs.newest_first(rows).select(
        "job_id", "filename", "status", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"),
        (~F.col("status").isin("queued", "running")).alias("has_results"),
        jobs.job_key(F.col("job_id").cast("string"), F.col("filename")).alias("job_key"),
    )


@query("finished_jobs", f"WITH {STATUS} SELECT job_id, status FROM status WHERE status NOT IN ('queued', 'running')")
def finished_jobs(spark, sf_dir):
    rows = jobs.job_status(derive.status_events(read(spark, sf_dir, "events")))
    return jobs.finished(rows).select("job_id", "status")


@query("job_counts", f"""
WITH {STATUS}
SELECT count(*) AS jobs, count(*) FILTER (status = 'running') AS running FROM status""")
def job_counts(spark, sf_dir):
    return jobs.job_counts(jobs.job_status(derive.status_events(read(spark, sf_dir, "events"))))


@query("job_log_concat", """
WITH numbered AS (
  SELECT event_id // 4 AS job_id, row_number() OVER (PARTITION BY event_id // 4 ORDER BY ts, event_id) AS n,
    '::STAGE::' || CASE WHEN event_id % 50 = 49 THEN 'x' ELSE
       CASE event_type WHEN 'view' THEN '1' WHEN 'click' THEN '2' WHEN 'signup' THEN '3' WHEN 'error' THEN '3.5' ELSE '4' END END
    || CASE WHEN event_id % 2 = 0 THEN '::' || event_type ELSE '' END || chr(10) AS line
  FROM events)
SELECT job_id, CAST((n - 1) // 10000 AS INT) AS part, count(*) AS lines, string_agg(line, '' ORDER BY n) AS log
FROM numbered GROUP BY 1, 2""")
def job_log_concat(spark, sf_dir):
    return jobs.job_logs(derive.stage_lines(read(spark, sf_dir, "events")))


@query("stream_stage_state", f"""
WITH {MARKERS}
SELECT job_id, arg_max(stage, ts) AS stage, arg_max(stage_label, ts) AS stage_label, epoch_us(max(ts)) AS updated_us
FROM markers GROUP BY 1""")
def stream_stage_state(spark, sf_dir):
    lines = derive.stage_lines(_event_stream(spark, sf_dir))
    feed = work_path(spark, "stage-feed")
    changes = stage_stream.change_feed(stage_stream.stage_state(lines), feed, work_path(spark, "stage-feed-progress"))
    changes.awaitTermination()
    return stage_stream.latest_state(spark, feed).select(
        "job_id", "stage", "stage_label", F.unix_micros("updated_at").alias("updated_us"))


@query("stream_log_lines", f"""
WITH {MARKERS}
SELECT job_id, arg_max(stage, ts) AS stage, arg_max(stage_label, ts) AS stage_label, epoch_us(max(ts)) AS updated_us
FROM markers GROUP BY 1""")
def stream_log_lines(spark, sf_dir):
    """Stage lines as text logs, written first and then followed line by line."""
    lines = derive.stage_lines(read(spark, sf_dir, "events"))
    logs = work_path(spark, "stage-logs")
    time = F.unix_micros(F.col("ts").cast("timestamp")).cast("string")
    lines.select(F.concat_ws("\t", time, F.col("job_id").cast("string"), F.rtrim("line", F.lit("\n")))).write.text(logs)
    followed = log_source.stage_lines(log_source.log_lines(spark, logs, work_path(spark, "stage-logs-read")))
    feed = work_path(spark, "log-feed")
    stage_stream.change_feed(stage_stream.stage_state(followed), feed, work_path(spark, "log-feed-progress"), drain=True)
    return stage_stream.latest_state(spark, feed).select("job_id", "stage", "stage_label", F.unix_micros("updated_at").alias("updated_us"))
