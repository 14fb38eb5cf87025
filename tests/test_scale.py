"""What bounds the work of one task: portions by bytes, tasks by files, sorts by partition, patterns tried once."""

import pyarrow as pa
from pyspark.sql import functions as F

from patchloom import config
from patchloom.operators import brace, replay, replies
from patchloom.plans import io_queries
from patchloom.sources import corpus, documents, envelopes


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_paths_are_dealt_out_by_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "FILES", 2)
    rows = spark.createDataFrame([(f"a/{k}.txt", "x" * k) for k in range(9)], "path string, text string").coalesce(1)
    written = documents.write_documents(rows, str(tmp_path))
    back = documents.read_documents(written, str(tmp_path))
    assert back.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, back.collect())) == [(f"a/{k}.txt", "x" * k) for k in range(9)]


def test_texts_are_read_many_to_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"{k}.txt", "x") for k in range(50)], "path string, text string")
    back = documents.read_documents(documents.write_documents(rows, str(tmp_path)), str(tmp_path))
    sizes = back.coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    assert [r["n"] for r in sizes.collect()] == [50]


def test_archives_go_in_portions(spark, monkeypatch):
    monkeypatch.setattr(corpus, "PORTION", 10)
    batch = pa.RecordBatch.from_pydict({"text": ["123456", None, "1234", "1", "12345678901234", "", "12"]})
    assert [p.column(0).to_pylist() for p in corpus.portions(batch, "text")] == [["123456", None, "1234"], ["1"], ["12345678901234"], ["", "12"]]
    made = spark.createDataFrame([(f"a{k}", k, "text" * 5) for k in range(1, 4)], "file string, doc_id long, text string").mapInArrow(
        io_queries._archives, "file string, content binary")
    broken = made.select(F.concat("file", F.lit("b")).alias("file"), F.substring("content", 1, 9).alias("content"))
    empty = made.select("file", F.lit(None).cast("binary").alias("content"))
    found = corpus.expand_archives(made.unionByName(broken).unionByName(empty).coalesce(1))
    assert "UDTF" not in plan_of(found)
    rows = found.collect()
    assert len(rows) == 18 and sum(r["kept"] for r in rows) == 3 and sum(r["error"] is not None for r in rows) == 3
    assert {(r["archive"], r["member"]) for r in rows if r["kept"]} == {(f"a{k}", f"pkg/d{k}.py") for k in range(1, 4)}


def test_start_lines_are_looked_for_once(spark, tmp_path):
    spark.createDataFrame([("f", "c", "struct p {\n};\n")], "file string, language string, content string").write.parquet(str(tmp_path / "t"))
    files = spark.read.parquet(str(tmp_path / "t"))
    times = lambda df: plan_of(df).count(config.UNIT_PATTERNS[11][2])
    assert times(brace.brace_units(files)) == times(files.select(brace._found(None, False).alias("x")))
    assert [tuple(r) for r in brace.brace_units(files).collect()] == [("f", "c", "struct", "p", 1, 2)]


def test_lines_that_fit_hold_what_their_pattern_needs(spark):
    lines = [
        ("typescript", "export interface A {", "interface", "A"), ("javascript", "async function f<T>(a) {", "function", "f"),
        ("javascript", "const g = x => x", "function", "g"), ("typescript", "type T = {", "type_alias", "T"), ("javascript", "get m() {", "method", "m"),
        ("javascript", "if (a) {", None, None), ("java", "public A(", "constructor", "A"), ("java", "static int f(int a)", "method", "f"),
        ("java", "enum E {", "enum", "E"), ("cpp", "namespace n {", "namespace", "n"), ("c", "int f(int a) {", "function", "f"), ("c", "if (a) {", None, None),
        ("go", "func (r *R) F[T any](a T) {", "function", "F"), ("go", "type I interface {", "interface", "I"), ("rust", "pub(crate) fn f", "function", "f"),
        ("rust", "impl<T> A for B", "impl", "B"), ("php", "trait T", "trait", "T"), ("php", "function &f(", "function", "f"), ("ruby", "def a?", "method", "a?"),
        ("ruby", "class A::B", "class", "A::B"), ("python", "class A:", None, None), (None, "class A {", None, None)]
    rows = spark.createDataFrame([(i, k, text) for i, (k, text, _, _) in enumerate(lines)], "i int, language string, line string")
    found = rows.select("i", brace.match_line(F.col("language"), F.col("line")).alias("u")).orderBy("i").collect()
    assert [(r["u"]["type"], r["u"]["name"]) if r["u"] else (None, None) for r in found] == [(t, n) for _, _, t, n in lines]


def test_runs_are_dealt_out_before_they_are_sorted(spark, tmp_path):
    kind = "file string, func string, case_id long, side string, args string, ok boolean, result string, result_num double, result_type string, error string"
    spark.createDataFrame([("m", "f", 1, s, "[]", True, "1", 1.0, "int", None) for s in ("original", "refactored")], kind).write.parquet(str(tmp_path / "r"))
    paired = replay.pair_runs(spark.read.parquet(str(tmp_path / "r")))
    steps = [line for line in plan_of(paired).split("\n") if "Aggregate" in line or "Exchange" in line]
    assert "Exchange" in steps[-1] and sum("Exchange" in s for s in steps) == 1
    assert paired.count() == 1


def test_envelopes_are_parsed_once(spark, tmp_path):
    good = '{"file_name": "f", "language": "c", "chunks": [{"chunk_id": "chunk_1", "start_line": 1}]}'
    bad = [None, "oops", '{"file_name": "f", "language": "c"}', '{"file_name": "f", "language": "c", "chunks": {"a": 1}}']
    spark.createDataFrame([(k, t) for k, t in enumerate([good, *bad])], "n int, value string").write.parquet(str(tmp_path / "e"))
    rows, rejects = envelopes.parse_chunk_envelopes(spark.read.parquet(str(tmp_path / "e")), "value", keep=["n"])
    plan = plan_of(rows)
    assert plan.count("from_json(") == 1 and plan.count("get_json_object(") == 2
    assert [(r["n"], r["file"], r["chunk_id"]) for r in rows.collect()] == [(0, "f", "chunk_1")]
    assert [r["reject_reason"] for r in rejects.orderBy("n").collect()] == ["not JSON", "not JSON", "missing key: chunks", "'chunks' must be an array"]


def test_blocks_end_at_their_first_end(spark):
    reply = '<chunk id="a">　 x = 1 \n</chunk> <chunk id="b"></chunk><chunk id="c">\n```py\n y\n```\n</chunk><chunk id="d">```\n\n```</chunk>'
    rows = spark.createDataFrame([("f", 0, reply)], "file string, prompt_id long, reply string")
    found = {r["chunk_id"]: r["code"] for r in replies.batched_blocks(rows).collect()}
    assert found == {"a": "x = 1", "b": "", "c": "y", "d": ""}
