"""Job state as a stream: bounded state, late and repeated events, and the table it keeps."""

import random

import pytest
from pyspark.sql import functions as F

from patchloom.operators import jobs
from patchloom.streaming import job_stream
from patchloom.streaming.feed import Feed, newest

EVENT = "job_id LONG, ts TIMESTAMP, status STRING, stage DOUBLE, stage_label STRING"


def at(minutes):
    return F.timestamp_micros(F.lit(1_700_000_000_000_000 + int(minutes * 60_000_000)))


def events(spark, rows):
    """Rows of ``job, minute, status, stage``."""
    plain = spark.createDataFrame([(j, float(m), s, g) for j, m, s, g in rows], "job_id LONG, m DOUBLE, status STRING, stage DOUBLE")
    ts = F.timestamp_micros(F.lit(1_700_000_000_000_000) + (F.col("m") * 60_000_000).cast("long"))
    return plain.select("job_id", ts.alias("ts"), "status", "stage", F.when(F.col("stage").isNotNull(), F.lit("x")).alias("stage_label"))


def followed(spark, folder, batches):
    """Runs the stream once per batch of rows; returns the feed and the state size after each run."""
    source, sizes = str(folder / "in"), []
    feed = job_stream.job_feed(spark, str(folder / "feed"), every=3)
    for rows in batches:
        events(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENT).parquet(source)
        query = job_stream.keep_jobs(job_stream.job_changes(stream, delay="10 minutes"), feed, str(folder / "progress"))
        held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        sizes.append(held[-1])
    return feed, sizes


def test_state_stays_flat_and_the_table_holds_all(spark, tmp_path, rows):
    batches = [[(100 * n + k, 60 * n + k % 7, "running", 1.0) for k in range(20)] + [(100 * n + k, 60 * n + 8, "completed", 4.0) for k in range(15)]
               for n in range(6)]
    feed, sizes = followed(spark, tmp_path, batches)
    assert max(sizes) <= 20 and len(set(sizes[1:])) == 1
    table = feed.read()
    assert table.count() == 120
    state = job_stream.job_table(table).groupBy("status").count()
    assert rows(state) == [("completed", 90), ("running", 30)]
    # the five of each but the last hour ran past their limit
    assert rows(table.filter(job_stream.overdue(table)).select((F.floor(F.col("job_id") / 100)).alias("n")).groupBy("n").count()) == [
        (n, 5) for n in range(5)]


def test_any_order_and_repeats_give_the_batch_result(spark, tmp_path, rows):
    rng = random.Random(3)
    every = []
    for job in range(40):
        start = rng.uniform(0, 200)
        for _ in range(rng.randint(1, 6)):
            m = start + rng.choice([0, 1, 2, 5, 40])
            every.append((job, m, rng.choice(["queued", "running", "completed", "failed", "cancelled", None]), rng.choice([None, 1.0, 2.0, 3.5])))
    every.sort(key=lambda r: r[1])
    # late by less than the delay, and delivered twice
    moved = sorted(every + rng.sample(every, 30), key=lambda r: r[1] + rng.uniform(0, 9))
    feed, _ = followed(spark, tmp_path, [moved[k : k + 60] for k in range(0, len(moved), 60)])
    df = events(spark, every)
    want = jobs.job_status(df.filter("status IS NOT NULL"))
    got = job_stream.job_table(feed.read())
    columns = ["job_id", "status", "created_at", "updated_at", "started_at", "seen_at"]
    assert rows(got, *columns) == rows(want, *columns)
    marks = jobs.current_stage(df.filter("stage IS NOT NULL"))
    assert rows(got.filter("stage IS NOT NULL"), "job_id", "stage") == rows(marks.join(want, "job_id", "left_semi"), "job_id", "stage")


def test_a_feed_stays_small_and_takes_a_batch_once(spark, tmp_path, rows):
    feed = Feed(spark, str(tmp_path / "f"), newest("k"), every=4)
    batch = lambda n: spark.createDataFrame([(n % 5, n, f"v{n}"), (99, n, "last")], "k INT, batch_id INT, v STRING").coalesce(1)
    for n in range(23):
        feed.commit(batch(n), n)
        base, deltas = feed.snapshot()
        assert len(deltas) < 4 and len(list((tmp_path / "f" / "delta").iterdir())) == len(deltas)
    assert len(list((tmp_path / "f" / "base").iterdir())) <= 2
    want = [(18 + (k - 18) % 5, f"v{18 + (k - 18) % 5}") for k in range(5)]
    assert rows(feed.read().filter("k < 5"), "batch_id", "v") == sorted(want)
    for n in (3, 22, 17):
        feed.commit(batch(n), n)
    assert rows(feed.read(), "k", "batch_id") == sorted([((b % 5), b) for b, _ in want] + [(99, 22)])


def test_an_unfinished_folder_does_not_count(spark, tmp_path, rows):
    feed = Feed(spark, str(tmp_path / "f"), newest("k"), every=2)
    with pytest.raises(ValueError):
        feed.read()
    one = spark.createDataFrame([(1, 0, "a")], "k INT, batch_id INT, v STRING")
    assert feed.read(one.schema).count() == 0
    feed.commit(one, 0)
    feed.commit(one.withColumn("batch_id", F.lit(1)), 1)
    (tmp_path / "f" / "base" / "000000000009").mkdir()
    assert feed.snapshot() == (1, []) and rows(feed.read(), "batch_id") == [(1,)]
