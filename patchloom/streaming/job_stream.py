"""Jobs as a stream with bounded state: stage, status and time limit per job.

State holds live jobs only. A job leaves it when the watermark has passed its end, its
time limit, or ``idle`` without being started; an event-time timer per bucket of jobs does
that, and a job that passes its limit is reported as it goes. Each change is a row of partial
aggregates, all minima and maxima, so rows of one job can be merged in any order and a
line that is delivered again changes nothing. The merged table gives what the batch
functions give over all events, also for a job that came back after it had left.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from patchloom import config
from patchloom.operators.jobs import TERMINAL, parse_markers
from patchloom.streaming.feed import EVERY, Feed

# Times are microseconds. Kept: the first end, the last status, first and last time, first
# start, the last marker; ``limit_us`` is the time limit that a job has passed.
FIELDS = [
    ("end_us", "long"), ("end_status", "string"), ("last_us", "long"), ("last_status", "string"), ("created_us", "long"),
    ("started_us", "long"), ("seen_us", "long"), ("mark_us", "long"), ("mark_stage", "double"), ("mark_label", "string"), ("limit_us", "long")]
NAMES = [n for n, _ in FIELDS]
_STATE = ", ".join(f"{n} {t}" for n, t in FIELDS)
# Groups of jobs that share one state and one timer.
BUCKETS = 4096
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def job_events(markers: DataFrame, statuses: DataFrame) -> DataFrame:
    """``job_id, ts, status, stage, stage_label``: stage lines and status changes in one stream."""
    marks = parse_markers(markers).select("job_id", "ts", F.lit(None).cast("string").alias("status"), "stage", "stage_label")
    return marks.unionByName(statuses.select(
        "job_id", "ts", "status", F.lit(None).cast("double").alias("stage"), F.lit(None).cast("string").alias("stage_label")))


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def _most(a, b):
    return b if a is None else a if b is None else max(a, b)


def folded(state: dict, us: int, status: str | None, stage: float | None, label: str | None) -> dict:
    """State after one event; pairs are compared by time, ties by value."""
    new = dict(state)
    if stage is not None:
        # equal times: the greater stage, then the greater label, as in batch
        held = None if state["mark_us"] is None else (state["mark_us"], state["mark_stage"], state["mark_label"])
        new["mark_us"], new["mark_stage"], new["mark_label"] = _most(held, (us, stage, label))
    if status is not None:
        if status in TERMINAL:
            held = None if state["end_us"] is None else (state["end_us"], state["end_status"])
            new["end_us"], new["end_status"] = _least(held, (us, status))
        held = None if state["last_us"] is None else (state["last_us"], state["last_status"])
        new["last_us"], new["last_status"] = _most(held, (us, status))
        new["created_us"], new["seen_us"] = _least(state["created_us"], us), _most(state["seen_us"], us)
        if status == "running":
            new["started_us"] = _least(state["started_us"], us)
    return new


class JobProcessor(StatefulProcessor):
    """State per bucket of jobs: the fields above and the expiry of each live job, and the timer of the
    next expiry. A call for the state goes from Python to the JVM, so it is made per bucket, not per job."""

    def __init__(self, limit_s: int, idle_s: int, kind: str = "long"):
        self.limit_us, self.idle_us, self.kind = limit_s * 1_000_000, idle_s * 1_000_000, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("jobs", f"jobs array<struct<{_columns(self.kind)}, expiry_ms: bigint>>, timer_ms long")

    def _expiry(self, state: dict) -> int:
        """First whole millisecond after the job's end, its time limit, or too long without a start."""
        us = _least(state["end_us"], self._limit(state))
        if us is None:
            us = _most(state["seen_us"], state["mark_us"]) + self.idle_us
        return us // 1000 + 1

    def _limit(self, state: dict) -> int | None:
        return None if state["started_us"] is None else state["started_us"] + self.limit_us

    def _live(self) -> tuple[dict, int | None]:
        """State and expiry of the bucket's jobs, and its timer."""
        held = self.held.get()
        if held is None:
            return {}, None
        return {job[0]: (dict(zip(NAMES, job[1:])), job[-1]) for job in held[0]}, held[1]

    def _keep(self, live: dict, timer: int | None, gone: bool = False) -> None:
        """``gone``: the timer has gone off, and is not there any more."""
        if not live:
            self.held.clear()
            return
        expiry = min(e for _, e in live.values())
        if timer is not None and timer != expiry and not gone:
            self.handle.deleteTimer(timer)
        if timer != expiry or gone:
            self.handle.registerTimer(expiry)
        self.held.update(([(job, *state.values(), e) for job, (state, e) in live.items()], expiry))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        live, timer = self._live()
        new = {}
        for job, us, status, stage, label in rows_of(rows):
            state = new.get(job)
            if state is None:
                state = live[job][0] if job in live else dict.fromkeys(NAMES)
            new[job] = folded(state, us, status, stage, label)
        new = {job: state for job, state in new.items() if job not in live or state != live[job][0]}
        # a line without a stage or status says nothing
        new = {job: state for job, state in new.items() if any(v is not None for v in state.values())}
        if not new:
            return
        live.update((job, (state, self._expiry(state))) for job, state in new.items())
        self._keep(live, timer)
        for job, state in new.items():
            yield Row(job_id=job, **state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        live, timer = self._live()
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        mark = timerValues.getCurrentWatermarkInMs()
        over = {job: state for job, (state, expiry) in live.items() if expiry < mark or expiry <= timer}
        self._keep({job: held for job, held in live.items() if job not in over}, timer, gone=True)
        for job, state in over.items():
            limit = self._limit(state)
            if limit is not None and (state["end_us"] is None or state["end_us"] > limit):
                yield Row(job_id=job, **{**state, "limit_us": limit})

    def close(self) -> None:
        pass


def rows_of(rows: Iterator[Row]) -> Iterator[tuple]:
    for row in rows:
        yield row["job_id"], row["us"], row["status"], row["stage"], row["stage_label"]


def _columns(kind: str) -> str:
    return f"job_id: {kind}, " + ", ".join(f"{n}: {t}" for n, t in FIELDS)


def job_changes(events: DataFrame, limit_s: int = config.JOB_TIME_LIMIT_S, idle_s: int = 86_400, delay: str = "1 hour",
                buckets: int = BUCKETS) -> DataFrame:
    """Stream of ``job_id`` and ``FIELDS``: what is known of a job after each change. The state is kept in
    ``buckets`` of jobs; a bucket that changes is written whole, so it should hold a few thousand live jobs
    at most, and the number must stay the same over the life of a stream."""
    kind = events.schema["job_id"].dataType.simpleString()
    rows = events.withWatermark("ts", delay).withColumn("us", F.unix_micros("ts")).withColumn(
        "bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int"))
    return rows.groupBy("bucket").transformWithState(
        statefulProcessor=JobProcessor(limit_s, idle_s, kind), outputStructType=f"job_id {kind}, {_STATE}", outputMode="Update", timeMode="EventTime")


def merged(rows: DataFrame) -> DataFrame:
    """One row per job from any rows of it."""
    some = lambda us, *rest: F.when(F.col(us).isNotNull(), F.struct(us, *rest))
    return rows.groupBy("job_id").agg(
        F.min(some("end_us", "end_status")).alias("_end"), F.max(some("last_us", "last_status")).alias("_last"),
        F.min("created_us").alias("created_us"), F.min("started_us").alias("started_us"), F.max("seen_us").alias("seen_us"),
        F.max(some("mark_us", "mark_stage", "mark_label")).alias("_mark"), F.min("limit_us").alias("limit_us"),
    ).select("job_id", "_end.*", "_last.*", "created_us", "started_us", "seen_us", "_mark.*", "limit_us").select("job_id", *NAMES)


def job_table(rows: DataFrame) -> DataFrame:
    """``job_id, status, created_at, updated_at, started_at, seen_at, stage, stage_label, stage_at,
    limit_at`` of merged rows, in the form that ``jobs.timeouts`` and ``jobs.final_stage`` take."""
    time = lambda c: F.timestamp_micros(F.col(c))
    return rows.filter("last_us IS NOT NULL").select(
        "job_id", F.coalesce("end_status", "last_status").alias("status"), time("created_us").alias("created_at"),
        F.coalesce(time("end_us"), time("last_us")).alias("updated_at"), time("started_us").alias("started_at"), time("seen_us").alias("seen_at"),
        F.col("mark_stage").alias("stage"), F.col("mark_label").alias("stage_label"), time("mark_us").alias("stage_at"), time("limit_us").alias("limit_at"))


def overdue(rows: DataFrame) -> Column:
    """Whether a merged job passed its time limit before anything ended it."""
    return F.col("limit_us").isNotNull() & (F.col("end_us").isNull() | (F.col("end_us") > F.col("limit_us")))


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Timers need the state store that keeps its keys in order."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def job_feed(spark: SparkSession, path: str, every: int = EVERY) -> Feed:
    return Feed(spark, path, merged, every)


def keep_jobs(changes: DataFrame, feed: Feed, checkpoint: str) -> StreamingQuery:
    """Bring the table up to date with all that has arrived, then stop."""
    spark = feed.spark
    with keyed_state(spark):
        query = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(
            availableNow=True).foreachBatch(feed.commit).start()
        query.awaitTermination()
    return query


def feed_schema(spark: SparkSession, job_kind: str = "long") -> StructType:
    return spark.createDataFrame([], f"job_id {job_kind}, {_STATE}").schema
