"""Stage markers as a stream: the same parsing as in batch, state per job, change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from patchloom import schemas
from patchloom.operators.jobs import TERMINAL, parse_markers
from patchloom.streaming.feed import EVERY, Feed, newest


def line_stream(spark: SparkSession, path: str, schema: str = schemas.EVENT_LINE, **options: str) -> DataFrame:
    """Stream of event rows from parquet files that arrive under ``path``."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def without_replays(lines: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop lines delivered again within the watermark."""
    return lines.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["job_id", "ts", "line"])


def stage_state(lines: DataFrame) -> DataFrame:
    """Latest stage per job; one small state row per job, kept by native aggregates."""
    last = F.max(F.struct("ts", "stage", "stage_label")).alias("m")
    return parse_markers(lines).groupBy("job_id").agg(last).select(
        "job_id", "m.stage", "m.stage_label", F.col("m.ts").alias("updated_at")
    )


def status_state(events: DataFrame) -> DataFrame:
    """Status per job: the first terminal status stays, else the latest counts."""
    row = F.struct("ts", "status")
    return events.groupBy("job_id").agg(
        F.min(F.when(F.col("status").isin(TERMINAL), row)).alias("_end"), F.max(row).alias("_last")
    ).select("job_id", F.coalesce("_end.status", "_last.status").alias("status"))


def silent_jobs(lines: DataFrame, limit: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Jobs without a line for ``limit`` of event time, once the watermark passes them."""
    return (
        lines.withWatermark("ts", delay)
        .groupBy("job_id", F.session_window("ts", limit))
        .agg(F.count(F.lit(1)).alias("lines"))
        .select("job_id", F.col("session_window.start").alias("started_at"),
                F.col("session_window.end").alias("expired_at"), "lines")
    )


def _feed(spark: SparkSession, path: str, key: str, every: int = EVERY) -> Feed:
    return Feed(spark, path, newest(key), every)


def change_feed(
    state: DataFrame, path: str, checkpoint: str, key: str = "job_id", every: int = EVERY, drain: bool = False,
) -> StreamingQuery:
    """Write every change of ``state``, tagged with its batch, into a feed under ``path``, then stop.

    The feed is one base and fewer than ``every`` deltas however many batches there were;
    a repeated batch changes nothing. ``drain`` runs batch after batch until nothing is
    left, for sources that limit a batch themselves.
    """
    feed = _feed(state.sparkSession, path, key, every)

    def write(changes: DataFrame, batch_id: int) -> None:
        feed.commit(changes.withColumn("batch_id", F.lit(batch_id)), batch_id)

    writer = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    if not drain:
        return writer.trigger(availableNow=True).start()
    query = writer.start()
    query.processAllAvailable()
    query.stop()
    return query


def latest_state(spark: SparkSession, path: str, key: str = "job_id") -> DataFrame:
    """The newest row per key of a change feed."""
    return _feed(spark, path, key).read().drop("batch_id")
