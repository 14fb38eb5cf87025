"""Files on disk, archives, examples, streams."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from patchloom.operators import jobs, languages
from patchloom.plans.prompt_queries import EXAMPLES
from patchloom.session import work_path
from patchloom.sources import corpus, documents, envelopes
from patchloom.streaming import stage_stream


def test_scan_and_decode(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.py").write_bytes("é = 1\n".encode())
    (tmp_path / "sub" / "b.py").write_bytes("é = 2\n".encode("latin-1"))
    (tmp_path / "c.txt").write_text("no")
    found = corpus.scan_files(spark, [str(tmp_path), str(tmp_path / "missing")])
    texts = found.select(F.regexp_extract("file", r"([^/]*)\z", 1).alias("n"), corpus.decode(F.col("content")).alias("t"))
    assert {r["n"]: r["t"] for r in texts.collect()} == {"a.py": "é = 1\n", "b.py": "é = 2\n"}
    flat = corpus.scan_files(spark, str(tmp_path), recursive=False)
    assert flat.count() == 1
    with pytest.raises(FileNotFoundError):
        corpus.scan_files(spark, str(tmp_path / "missing"))


def archive(names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in names:
            z.writestr(name, f"# {name}")
    return out.getvalue()


def test_archives(spark):
    data = [
        ("ok.zip", bytearray(archive(["p/a.py", "p/", "__pycache__/x.py", "__init__.py", "/abs.py", "p/../../up.py", "t.txt"]))),
        ("bad.zip", bytearray(b"not a zip")), ("null.zip", None),
    ]
    got = corpus.expand_archives(spark.createDataFrame(data, "file STRING, content BINARY")).collect()
    assert [r["member"] for r in got if r["kept"]] == ["p/a.py"]
    assert [r["archive"] for r in got if r["error"]] == ["bad.zip"]


def test_admission(spark):
    data = [("a.py",), ("b.zip",), ("c.txt",), ("../d.py",), ("/e.py",), ("C:\\f.py",), ("x/..y/g.py",)]
    uploads = spark.createDataFrame(data, "file STRING")
    got = {r["file"]: r["reject_reason"] for r in corpus.admit(uploads).collect()}
    assert [f for f, r in got.items() if r is None] == ["a.py", "b.zip", "x/..y/g.py"]
    assert corpus.admit(uploads, "zip").filter("reject_reason IS NULL").count() == 1
    with pytest.raises(ValueError):
        corpus.require_any(uploads.filter("false"))


def test_examples_source(spark, tmp_path):
    assert envelopes.read_examples(spark, str(tmp_path / "none.json")).isEmpty()
    (tmp_path / "bad.json").write_text("{oops")
    assert envelopes.read_examples(spark, str(tmp_path / "bad.json")).isEmpty()
    names = ["id", "language", "chunk_type", "description", "before", "after", "notes"]
    (tmp_path / "e.json").write_text(json.dumps({"examples": [dict(zip(names, e)) for e in EXAMPLES]}, indent=1))
    assert [r["id"] for r in envelopes.read_examples(spark, str(tmp_path / "e.json")).orderBy("position").collect()] == ["e1", "e2", "e3", "e4", "e5"]


def test_routes(spark, rows):
    files = spark.createDataFrame([("a.KT",), ("b.rs",), ("c.rb",), ("d",)], "file STRING")
    accepted, rejected = languages.routed(languages.detect(files))
    assert rows(accepted, "file") == [("b.rs",)] and rejected.count() == 3


LINES = [
    (1, "2024-01-01 00:00:00", "::STAGE::1::cAST"), (1, "2024-01-01 00:00:05", "::STAGE::2"), (1, "2024-01-01 00:00:09", "noise"),
    (2, "2024-01-01 00:01:00", "::STAGE::3.5::fix"), (1, "2024-01-01 00:02:00", "::STAGE::2"), (2, "2024-01-01 00:00:30", "::STAGE::3"),
]


def lines(spark):
    df = spark.createDataFrame(LINES, "job_id LONG, ts STRING, line STRING")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def test_stream_equals_batch(spark, rows, tmp_path):
    lines(spark).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = stage_stream.line_stream(spark, str(tmp_path / "in"), maxFilesPerTrigger="1")
    feed = work_path(spark, "feed")
    stage_stream.change_feed(stage_stream.stage_state(stream), feed, work_path(spark, "progress")).awaitTermination()
    batch = jobs.current_stage(jobs.parse_markers(lines(spark)))
    assert rows(stage_stream.latest_state(spark, feed)) == rows(batch)


def test_replayed_lines_and_silence(spark, tmp_path):
    twice = lines(spark).unionByName(lines(spark))
    later = spark.createDataFrame([(9, "2024-01-02 00:00:00", "::STAGE::1")], "job_id LONG, ts STRING, line STRING").withColumn("ts", F.col("ts").cast("timestamp"))
    twice.coalesce(1).write.parquet(str(tmp_path / "in"))
    later.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = stage_stream.line_stream(spark, str(tmp_path / "in"))
    out = work_path(spark, "dedup")
    query = stage_stream.without_replays(source).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", work_path(spark, "dedup-progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(out).count() == 7
    quiet = work_path(spark, "quiet")
    stage_stream.silent_jobs(source).writeStream.format("parquet").option("path", quiet).option(
        "checkpointLocation", work_path(spark, "quiet-progress")).trigger(availableNow=True).start().awaitTermination()
    assert {r["job_id"] for r in spark.read.parquet(quiet).collect()} == {1, 2}


def test_statuses(spark):
    data = [(1, 1, "queued"), (1, 2, "cancelled"), (1, 3, "completed"), (2, 1, "queued"), (2, 2, "running")]
    df = spark.createDataFrame(data, "job_id INT, ts INT, status STRING")
    assert {r["job_id"]: r["status"] for r in jobs.job_status(df).collect()} == {1: "cancelled", 2: "running"}
    assert {r["job_id"]: r["status"] for r in stage_stream.status_state(df).collect()} == {1: "cancelled", 2: "running"}
    assert jobs.finished(jobs.job_status(df)).count() == 1


def test_documents_are_written_all_or_none(spark, tmp_path, rows):
    root = str(tmp_path / "out")
    made = lambda *r: spark.createDataFrame(list(r), "path STRING, text STRING").repartition(3)
    files = lambda: {str(f.relative_to(root)): f.read_text() for f in (tmp_path / "out").rglob("*") if f.is_file() and "_manifests" not in f.parts}
    first = documents.write_documents(made(("a/b/x.refactored.py", "é\n"), ("__init__.py", None), ("y.json", "{}")), root)
    assert files() == {"a/b/x.refactored.py": "é\n", "__init__.py": "", "y.json": "{}"}
    assert rows(documents.read_documents(first, root)) == [("__init__.py", ""), ("a/b/x.refactored.py", "é\n"), ("y.json", "{}")]
    before = files()
    for bad in ("../up.py", "/abs.py", "a//b.py", "a/./b.py", "", None, "_staging-1/x", "a\\b"):
        with pytest.raises(Exception, match="no safe path"):
            documents.write_documents(made(("new.py", "1"), (bad, "2"), ("a/b/x.refactored.py", "changed")), root)
        assert files() == before
    with pytest.raises(ValueError, match="two rows name 'z.py'"):
        documents.write_documents(made(("z.py", "1"), ("z.py", "2")), root)
    assert files() == before
    documents.write_documents(made(("y.json", "[]"), ("_manifest.txt", "kept")), root)
    assert files() == {**before, "y.json": "[]", "_manifest.txt": "kept"}
    assert documents.write_documents(made().limit(0), root).count() == 0 and not list((tmp_path / "out").glob("_staging*"))
