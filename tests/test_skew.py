"""The heavy-group route must give what the plain window gives."""

import random

import pytest
from pyspark.sql import functions as F

from patchloom.operators import chunks, jobs
from patchloom.skew import heavy_keys, scan_within


def one_hot(spark, n=400, seed=7):
    """A third of all rows in one file, few distinct starts, a unique emit key."""
    rng = random.Random(seed)
    data = [
        ("hot" if i % 3 == 0 else f"f{i % 60}", i, rng.randint(1, 20), 0) for i in range(n)
    ]
    data = [(f, i, s, s + rng.randint(0, 9)) for f, i, s, _ in data]
    return spark.createDataFrame(data, "file STRING, emit INT, start_line INT, end_line INT").repartition(4)


def test_heavy_keys_finds_the_hot_one(spark):
    df = one_hot(spark)
    spark.conf.set("patchloom.heavyRows", "50")
    try:
        assert set(heavy_keys(df, "file")) == {"hot"}
    finally:
        spark.conf.unset("patchloom.heavyRows")
    assert heavy_keys(df, "file") == {}


def test_heavy_keys_of_nothing(spark, heavy):
    df = one_hot(spark)
    assert heavy_keys(df.filter("false"), "file") == {}
    assert heavy_keys(df.withColumn("file", F.lit(None).cast("string")), "file") == {}


@pytest.mark.parametrize("limit", ["3", "50"])
def test_scan_equals_plain_window(spark, rows, limit):
    df = one_hot(spark)
    order = [F.col("start_line"), F.col("end_line").desc(), F.col("emit")]
    plain = rows(scan_within(df, ["file"], order, rank="n", max_before={"m": "end_line"}, heavy={}))
    spark.conf.set("patchloom.heavyRows", limit)
    try:
        split = scan_within(df, ["file"], order, rank="n", max_before={"m": "end_line"})
        assert rows(split) == plain
    finally:
        spark.conf.unset("patchloom.heavyRows")


def naive_kept(data):
    return sorted(
        (f, i) for f, i, s, e in data
        if not any(
            g == f and s2 <= s and e2 >= e and ((s2, e2) != (s, e) or j < i) and j != i for g, j, s2, e2 in data
        )
    )


def test_containment_equals_pairwise(spark, rows, heavy):
    df = one_hot(spark, 200)
    data = [tuple(r) for r in df.collect()]
    assert rows(chunks.drop_nested(df, ["emit"]), "file", "emit") == sorted(naive_kept(data), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_prompt_containment_equals_pairwise(spark, rows, heavy, seed):
    df = one_hot(spark, 150, seed)
    prompts = chunks.batch(chunks.renumber(df, ["emit"]), 3, ["chunk_id", "start_line", "end_line"])
    flat = [(r["file"], r["prompt_id"], c["start_line"], c["end_line"]) for r in prompts.collect() for c in r["chunks"]]
    bad = {
        (f, p) for f, p, s, e in flat for g, q, s2, e2 in flat
        if f == g and p != q and s2 <= s and e2 >= e and ((s2, e2) != (s, e) or q < p)
    }
    expected = sorted({(f, p) for f, p, _, _ in flat} - bad, key=repr)
    assert rows(chunks.drop_nested_prompts(prompts), "file", "prompt_id") == expected


def test_many_keys_just_over_the_threshold(spark, rows, monkeypatch):
    data = [(f"k{i % 80}", i, i % 7, i % 7 + 1) for i in range(400)]  # five rows each
    df = spark.createDataFrame(data, "file STRING, emit INT, start_line INT, end_line INT")
    order = [F.col("start_line"), F.col("emit")]
    plain = rows(scan_within(df, ["file"], order, rank="n", heavy={}))
    spark.conf.set("patchloom.heavyRows", "5")
    try:
        found = heavy_keys(df, "file")
        assert len(found) == 80 and set(found.values()) == {5}
        assert rows(scan_within(df, ["file"], order, rank="n", heavy=found)) == plain
        monkeypatch.setattr("patchloom.skew.LISTED_KEYS", 10)
        assert rows(scan_within(df, ["file"], order, rank="n", heavy=found)) == plain
    finally:
        spark.conf.unset("patchloom.heavyRows")


def test_logs_come_in_parts(spark, heavy):
    data = [(1 if i % 3 else 2, i // 2, i, f"l{i}\n") for i in range(50)]
    lines = spark.createDataFrame(data, "job_id INT, ts INT, seq INT, line STRING").repartition(3)
    parts = jobs.job_logs(lines, part_lines=7).collect()
    assert max(r["lines"] for r in parts) == 7
    for job in (1, 2):
        whole = "".join(r["log"] for r in sorted(parts, key=lambda r: r["part"]) if r["job_id"] == job)
        assert whole == "".join(line for j, _, _, line in data if j == job)
