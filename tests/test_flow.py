"""A small corpus through every stage, including a retry."""

import json

from pyspark.sql import functions as F

from patchloom.operators import attempts, replies, rollup
from patchloom.plans import flow, rounds
from patchloom.sources import envelopes
from patchloom.plans.prompt_queries import EXAMPLE_SCHEMA

SHOP = '''class Cart:
    def add(self, item):
        self.items.append(item)

    def total(self):
        return sum(self.items)


def discount(price, rate=0.1):
    return price * (1 - rate)
'''
APP = """class View {
  draw() { return "}"; }
}
function start() {
  new View().draw();
}
"""


def corpus(spark):
    data = [("a/shop.py", SHOP), ("b/shop.py", "x = 1\n"), ("web/app.js", APP), ("bad.py", "def f(:\n"), ("q.rb", "def a; end"), ("n.txt", "")]
    return spark.createDataFrame(data, "file STRING, content STRING")


def examples(spark):
    return spark.createDataFrame([("e", "python", "function", "", "b", "a", "n", 0)], EXAMPLE_SCHEMA)


def test_chunks_and_rejects(spark, rows):
    made = flow.chunk_corpus(corpus(spark))
    assert rows(made.chunks, "file", "chunk_id", "type", "name", "start_line", "end_line") == [
        ("a/shop.py", "chunk_1", "class", "Cart", 1, 6), ("a/shop.py", "chunk_2", "method", "add", 2, 3),
        ("a/shop.py", "chunk_3", "method", "total", 5, 6), ("a/shop.py", "chunk_4", "function", "discount", 9, 10),
        ("web/app.js", "chunk_1", "class", "View", 1, 3), ("web/app.js", "chunk_2", "function", "start", 4, 6),
    ]
    codes = {r["chunk_id"]: r["code"] for r in made.chunks.filter("file = 'a/shop.py'").collect()}
    assert codes["chunk_2"] == "    def add(self, item):\n        self.items.append(item)"
    assert {r["file"]: r["reject_reason"] for r in made.rejects.collect()} == {
        "bad.py": "SyntaxError at line 1, col 7: invalid syntax", "q.rb": "No parser registered for language 'ruby'",
        "n.txt": "Unsupported file extension '.txt'",
    }


def test_prompts(spark):
    made = flow.chunk_corpus(corpus(spark))
    single = {(r["file"], r["prompt_id"]): r for r in flow.build_prompts(made.chunks, corpus(spark), examples(spark)).collect()}
    assert len(single) == 6
    method = single[("a/shop.py", 1)]["prompt"]
    assert "It is add (method" in method and SHOP in method and "For comparison" not in method
    assert "For comparison, a revision that was accepted. From\n\nb\n" in single[("a/shop.py", 3)]["prompt"]
    assert "class Cart from a/shop.py" in single[("a/shop.py", 0)]["prompt"]
    batched = flow.build_prompts(made.chunks, corpus(spark), examples(spark), batch_size=3).collect()
    assert sorted((r["file"], r["prompt_id"], len(r["chunks"])) for r in batched) == [
        ("a/shop.py", 0, 3), ("a/shop.py", 1, 1), ("web/app.js", 0, 2)]


def echo(prompts):
    """Replies that give every chunk back unchanged."""
    block = F.array_join(F.transform("chunks", lambda c: F.concat(
        F.lit('<chunk id="'), c["chunk_id"], F.lit('">\n```python\n'), c["code"], F.lit("\n```\n</chunk>"))), "\n")
    fence = F.concat(F.lit("```python\n"), F.get("chunks", F.lit(0))["code"], F.lit("\n```"))
    return prompts.select("file", "prompt_id", F.when(F.col("is_batch"), block).otherwise(fence).alias("reply"))


def test_round_trip(spark):
    files = corpus(spark)
    made = flow.chunk_corpus(files)
    for size in (1, 3):
        prompts = flow.build_prompts(made.chunks, files, examples(spark), batch_size=size)
        done = flow.apply_replies(files, prompts, echo(prompts))
        assert {r["file"]: r["content"] for r in done.files.collect()} == {r["file"]: r["content"] for r in files.collect()}
        assert {r["file"]: r["applied"] for r in done.counts.collect()} == {"a/shop.py": 2, "web/app.js": 2}
        assert done.missing.isEmpty() and done.rejected.isEmpty()


def test_prompt_mode_and_missing(spark, rows):
    files = corpus(spark).filter("file = 'a/shop.py'")
    made = flow.chunk_corpus(files)
    prompts = flow.build_prompts(made.chunks, files, examples(spark))
    reply = spark.createDataFrame([("a/shop.py", 0, "```\nclass Cart:\n    pass\n```"), ("a/shop.py", 1, "```\nlost\n```")], "file STRING, prompt_id LONG, reply STRING")
    done = flow.apply_replies(files, prompts, reply, mode="prompt")
    assert done.files.head()["content"] == SHOP.replace(SHOP[: SHOP.index("\n\n\ndef")], "class Cart:\n    pass")
    assert rows(done.missing, "prompt_id") == [(3,)]


def test_unanswered_container_still_covers(spark):
    files = corpus(spark).filter("file = 'a/shop.py'")
    prompts = flow.build_prompts(flow.chunk_corpus(files).chunks, files, examples(spark))
    reply = spark.createDataFrame(
        [("a/shop.py", 1, "```\nlost\n```"), ("a/shop.py", 3, "```\nnew\n```")], "file STRING, prompt_id LONG, reply STRING")
    done = flow.apply_replies(files, prompts, reply)
    assert done.files.head()["content"] == SHOP[: SHOP.index("def discount")] + "new\n"
    assert [r["prompt_id"] for r in done.missing.collect()] == [0]


def run(file, func, case, side, ok=True, result="1", kind="int", error=None, args="[1]"):
    return (file, func, case, side, args, ok, result if ok else None, float(result) if ok else None, kind if ok else None, error)


RUN_SCHEMA = (
    "file STRING, func STRING, case_id LONG, side STRING, args STRING, ok BOOLEAN, result STRING, result_num DOUBLE, result_type STRING, error STRING"
)


def pairs(spark):
    good = "def f(a):\n    return a\n\n\ndef g():\n    pass\n"
    originals = spark.createDataFrame([("ok.py", good), ("bad.py", good), ("odd.py", good), ("gone.py", good)], "file STRING, content STRING")
    rewritten = spark.createDataFrame(
        [("ok.py", good), ("bad.py", "def f(:\n"), ("odd.py", "def f(a, b):\n    return a\n\n\ndef g(*x): \n    pass\n")], "file STRING, content STRING")
    return originals, rewritten


def test_validate_and_retry(spark, tmp_path):
    originals, rewritten = pairs(spark)
    runs = spark.createDataFrame([
        run("ok.py", "f", 1, "original"), run("ok.py", "f", 1, "refactored"),
        run("odd.py", "f", 1, "original"), run("odd.py", "f", 1, "refactored", result="2"),
        run("odd.py", "f", 2, "original", ok=False, error="ValueError: a"), run("odd.py", "f", 2, "refactored", ok=False, error="KeyError: b"),
        run("odd.py", "g", 1, "original"),
    ], RUN_SCHEMA)
    results, _ = flow.validate(originals, rewritten, runs)
    got = {r["file"]: r for r in results.collect()}
    assert {f: (r["status"], r["severity"]) for f, r in got.items()} == {
        "ok.py": ("PASS", "pass"), "bad.py": ("FAIL", "error"), "odd.py": ("FAIL", "warning"), "gone.py": ("SKIP", "skip")}
    assert got["gone.py"]["first_failure"] == "Refactored file not found: gone.refactored.py"
    odd = {c["check"]: c["message"] for c in got["odd.py"]["checks"]}
    assert odd["ast_structure"] == (
        "Function 'f': positional arg count changed 1 → 2; Function 'g': *args presence changed False → True")
    assert odd["functional"] == "0/3 tests passed (0%); 1 property violation(s)"
    assert [c["check"] for c in got["bad.py"]["checks"]] == ["syntax"]
    assert rollup.repo_summary(results).head().asDict() == {
        "total": 4, "passed": 1, "skipped": 1, "failed": 2, "all_pass": False, "pass_or_skip": False}

    rollup.write_summary(results, str(tmp_path / "summary"))
    written = [json.loads(l) for f in (tmp_path / "summary").glob("part*") for l in f.read_text().splitlines()]
    assert {w["file"]: w["status"] for w in written} == {f: r["status"] for f, r in got.items()}
    assert next(w for w in written if w["file"] == "ok.py")["checks"]["syntax"] is True

    first = flow.attempt_row(results)
    again = attempts.to_retry(first)
    assert {r["file"] for r in again.collect()} == {"bad.py", "odd.py"}
    prompts = spark.createDataFrame([("bad.py", 0, "TASK"), ("ok.py", 0, "TASK")], "file STRING, prompt_id LONG, prompt STRING")
    retried = flow.retry_prompts(prompts, results).collect()
    rates = {f: r["pass_rate"] for f, r in got.items()}
    assert rates["bad.py"] == 0.0 and rates["gone.py"] is None
    assert len(retried) == 1 and retried[0]["prompt"].endswith("TASK") and "[syntax] SyntaxError at line 1" in retried[0]["prompt"]
    second = spark.createDataFrame([("bad.py", True, "pass", "—"), ("odd.py", None, None, None)], "file STRING, retry_val_passed BOOLEAN, retry_severity STRING, retry_error STRING")
    final = attempts.merge_attempts(first, second)
    assert {r["file"]: r["final_status"] for r in final.collect()} == {"ok.py": "PASS", "bad.py": "PASS", "odd.py": "FAIL", "gone.py": "SKIP"}
    assert attempts.run_summary(final).head().asDict() == {
        "total": 4, "passed": 2, "failed": 1, "skipped": 1, "retried": 2, "recovered": 1, "all_pass": False}


def test_reports(spark):
    checks = [(0, "syntax", True, "Syntax OK"), (1, "linting", False, "x" * 200)]
    schema = (
        "file STRING, passed BOOLEAN, severity STRING, pass_rate DOUBLE, checks ARRAY<STRUCT<ord: INT, check: STRING, passed: BOOLEAN, message: STRING>>, "
        "total_tests LONG, passed_tests LONG, function_results MAP<STRING, STRUCT<total: LONG, passed: LONG, pass_rate: DOUBLE, failures: ARRAY<STRING>>>")
    results = spark.createDataFrame(
        [("a.py", False, "warning", 0.875, checks, 8, 7, {"f": (8, 7, 0.875, ["w" * 150, "2", "3", "4"])})], schema)
    failures = spark.createDataFrame(
        [("a.py", "f", i, "determinism", False, f"m{i}") for i in range(25)], "file STRING, func STRING, case_id INT, property STRING, passed BOOLEAN, message STRING")
    parts = rollup.json_reports(results, failures, part_rows=10).collect()
    docs = {r["part"]: json.loads(r["report"]) for r in parts}
    assert sorted(docs) == [0, 1, 2]
    assert [len(docs[p]["functional_detail"]["property_failures"]) for p in (0, 1, 2)] == [10, 10, 5]
    assert docs[0]["checks"]["syntax"] == {"passed": True, "message": "Syntax OK"}
    text = rollup.text_reports(results, failures).head()["report"]
    assert "  Pass Rate      : 87.5%" in text and "x" * 120 + "…" in text and "x" * 121 not in text
    assert "  ✗  f                               7/8 (88%)" in text
    assert text.count("↳") == 3 and text.count("[determinism]") == 10
    plain = json.loads(rollup.json_reports(results).head()["report"])
    assert "functional_detail" not in plain and plain["severity"] == "warning"


def test_envelopes_on_disk(spark, tmp_path):
    made = flow.chunk_corpus(corpus(spark)).chunks
    packed = envelopes.chunk_envelopes(made, part_rows=3)
    envelopes.write_envelopes(packed, str(tmp_path / "chunks"))
    back, bad = envelopes.read_chunk_envelopes(spark, str(tmp_path / "chunks"))
    assert bad.isEmpty()
    key = lambda df: sorted((r["file"], r["chunk_id"], r["code"], (r["metadata"] or {}).get("parent_class")) for r in df.collect())
    assert key(back) == key(made)
    line = next(l for f in (tmp_path / "chunks").glob("part*") for l in f.read_text().splitlines() if "web/app.js" in l)
    assert "metadata" not in line and json.loads(line)["total_chunks"] == 2
    prompts = flow.build_prompts(made, corpus(spark), examples(spark), batch_size=2)
    envelopes.write_envelopes(envelopes.prompt_envelopes(prompts), str(tmp_path / "prompts"))
    again = envelopes.read_prompt_envelopes(spark, str(tmp_path / "prompts"))
    assert sorted((r["file"], r["prompt_id"], r["prompt"]) for r in again.collect()) == sorted(
        (r["file"], r["prompt_id"], r["prompt"]) for r in prompts.collect())


def test_output_table(spark, tmp_path):
    files = corpus(spark).filter("file = 'a/shop.py'")
    named = files.withColumn("output", replies.output_name(F.col("file")))
    named.write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).head()["output"] == "a/shop.refactored.py"


def test_rounds_take_failed_files_only_and_end_when_nothing_changes(spark):
    files = spark.createDataFrame([(f"{n}.py", "def f(a):\n    return a\n") for n in ("ok", "late", "never", "mute", "lost")] + [
        ("broken.py", "def f(:\n")], "file STRING, content STRING")
    # attempt of the reply with the right signature; wrong replies before it
    mended = {"ok.py": 1, "late.py": 3, "never.py": 9, "lost.py": 9}
    asked = []

    def answer(prompts, attempt):
        asked.append({r["file"]: r["prompt"] for r in prompts.collect()})
        rows = []
        for r in prompts.collect():
            if r["file"] in mended and not (r["file"] == "lost.py" and attempt > 1):
                wrong = f"def f(a, b{attempt if r['file'] == 'late.py' else ''}):\n    return a"
                code = "def f(a):\n    return a" if attempt >= mended[r["file"]] else wrong
                rows.append((r["file"], r["prompt_id"], f"```\n{code}\n```"))
        return spark.createDataFrame(rows, "file STRING, prompt_id INT, reply STRING")

    done = rounds.run_rounds(files, examples(spark), answer, most=6)
    assert [set(a) for a in asked] == [{f"{n}.py" for n in ("ok", "late", "never", "mute", "lost")}, {"late.py", "never.py", "lost.py"}, {"late.py", "never.py"}, {"never.py"}]
    assert "positional arg count changed 1 → 2" in asked[1]["late.py"] and asked[1]["late.py"].endswith(asked[0]["late.py"])
    assert done.rounds == 4  # the fourth changed nothing
    got = {r["file"]: (r["final_status"], r["retried"], r["error"]) for r in done.merged.collect()}
    assert got["ok.py"][:2] == ("PASS", False) and got["late.py"][:2] == ("PASS", True)
    assert got["never.py"][:2] == ("FAIL", True) and "arg count" in got["never.py"][2]
    assert got["mute.py"] == ("SKIP", False, "Stage 3 failed") and got["broken.py"] == ("SKIP", False, "Stage 1 failed")
    assert got["lost.py"] == ("FAIL", True, rounds.NOT_AGAIN)
    texts = {r["file"]: r["content"] for r in done.files.collect()}
    assert texts["late.py"] == "def f(a):\n    return a\n" and set(texts) == {"ok.py", "late.py", "never.py", "lost.py"}
    assert done.attempts.filter("attempt = 3").count() == 2
