"""What a run leaves on disk: shuffle files and tables that nothing reads go, and a text is dealt out once."""

import os
import time

from pyspark.sql import functions as F

from patchloom.plans import flow, rounds
from patchloom.plans.prompt_queries import EXAMPLE_SCHEMA, EXAMPLES
from patchloom.session import cut_lineage


def _sources(spark, n=6):
    rows = [(f"{k}.py", f"class C{k}:\n    def m(self):\n        return {k}\n\n\ndef f{k}(a):\n    return a\n") for k in range(n)]
    return spark.createDataFrame(rows, "file STRING, content STRING")


def _echo(prompts):
    block = F.transform("chunks", lambda c: F.concat(F.lit('<chunk id="'), c["chunk_id"], F.lit('">\n```\n'), c["code"], F.lit("\n```\n</chunk>")))
    fence = F.concat(F.lit("```\n"), F.get("chunks", F.lit(0))["code"], F.lit("\n```"))
    return prompts.select("file", "prompt_id", F.when(F.col("is_batch"), F.array_join(block, "\n")).otherwise(fence).alias("reply"))


def _exchanged(plan, out):
    """Column names of every exchange of a plan."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return _exchanged(plan.initialPlan(), out)
    if plan.nodeName() == "Exchange":
        out.append({plan.output().apply(i).name() for i in range(plan.output().size())})
    for i in range(plan.children().size()):
        _exchanged(plan.children().apply(i), out)
    return out


def test_a_text_is_dealt_out_once_from_its_reply_to_its_file(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files, examples = _sources(spark), spark.createDataFrame(EXAMPLES, EXAMPLE_SCHEMA)
        for size in (1, 2):
            prompts = cut_lineage(flow.build_prompts(flow.chunk_corpus(files).chunks, files, examples, size))
            replies = cut_lineage(_echo(prompts))
            done = flow.apply_replies(files, prompts, replies)
            moved = _exchanged(done.files._jdf.queryExecution().executedPlan(), [])
            texts = [sorted(c & {"reply", "code", "body", "chunks", "_patches", "content"}) for c in moved]
            assert sorted(t for t in texts if t) == [["content"], ["reply"]]
            assert {r["file"]: r["content"] for r in done.files.collect()} == {r["file"]: r["content"] for r in files.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_repeated_and_null_keys_meet_as_in_a_join(spark, rows):
    """Two replies to one prompt, a repeated prompt, replies without a prompt or with null keys and texts."""
    files = spark.createDataFrame([("a", "x\ny\nz\n"), (None, "q\n")], "file STRING, content STRING")
    chunk = "chunks ARRAY<STRUCT<chunk_id: STRING, start_line: INT, end_line: INT>>"
    prompts = spark.createDataFrame([
        ("a", 0, False, [("chunk_1", 1, 1)]), ("a", 1, True, [("chunk_2", 2, 2), ("chunk_3", 3, 3)]), ("a", 2, False, []),
        (None, 0, False, [("chunk_1", 1, 1)]), ("a", None, False, [("chunk_4", 4, 4)])], f"file STRING, prompt_id LONG, is_batch BOOLEAN, {chunk}")
    replies = spark.createDataFrame([
        ("a", 0, "```\nX\n```"), ("a", 0, "```\n\n```"), ("a", 1, '<chunk id="chunk_3">```\nZ\n```</chunk><chunk id="chunk_9">n</chunk>'),
        ("a", 1, None), ("a", 2, "lost"), ("a", 7, "none"), (None, 0, "null"), ("a", None, "null")], "file STRING, prompt_id INT, reply STRING")
    done = flow.apply_replies(files, prompts, replies)
    assert rows(done.files) == sorted([("a", "X\ny\nZ\n", 2), (None, "q\n", 0)], key=repr)
    assert rows(done.missing, "prompt_id", "chunk_id") == sorted([(0, "chunk_1"), (1, "chunk_2"), (None, "chunk_4")], key=repr)
    twice = flow.apply_replies(files, prompts, replies.union(replies))
    assert rows(twice.counts.filter("file IS NOT NULL"), "applied") == [(4,)]


def test_shuffle_files_behind_a_cut_go(spark):
    blocks = lambda: {b.name() for b in (lambda s: [s.apply(i) for i in range(s.size())])(
        spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()) if b.isShuffle()}
    before = blocks()
    made = cut_lineage(spark.range(1000).withColumn("text", F.repeat(F.lit("text "), 100)).repartition(7, "id"))
    for _ in range(50):
        if blocks() <= before:
            break
        time.sleep(0.1)
    assert blocks() <= before and made.count() == 1000
    size = sum(os.path.getsize(f.removeprefix("file:")) for f in made.inputFiles())
    assert size < 100_000


def test_chunks_and_the_prompts_of_a_retry_go_with_their_round(spark, monkeypatch):
    files, tables, cut = _sources(spark, 2), [], rounds.cut_lineage

    def seen(df):
        tables.append(cut(df))
        return tables[-1]

    monkeypatch.setattr(rounds, "cut_lineage", seen)
    answer = lambda prompts, attempt: _echo(prompts).withColumn("reply", F.replace("reply", F.lit("(a)"), F.lit(f"(a, b{attempt})")))
    done = rounds.run_rounds(files, spark.createDataFrame(EXAMPLES, EXAMPLE_SCHEMA), answer, batch_size=2)
    assert done.rounds == 2 and {r["final_status"] for r in done.merged.collect()} == {"FAIL"}
    left = [t.columns for t in tables if any(os.path.exists(f.removeprefix("file:")) for f in t.inputFiles())]
    # the first prompts are asked for again, so of all that hold texts only they and the files of both rounds stay
    assert [("code" in c, "prompt" in c, "content" in c) for c in left if {"code", "prompt", "content"} & {*c}] == [
        (False, True, False), (False, False, True), (False, False, True)]
