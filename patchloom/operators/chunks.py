"""Chunk tables: numbering, containment, batches, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from patchloom.functions.gather import gather
from patchloom.functions.text import let, slice_lines, split_lines
from patchloom.skew import heavy_keys, scan_within


def renumber(chunks: DataFrame, emit: list[str], heavy: dict | None = None) -> DataFrame:
    """``chunk_no`` 1..n per file by start line, ties in emit order; ``chunk_id`` from it."""
    numbered = scan_within(
        chunks, ["file"], [F.col("start_line"), *[F.col(c) for c in emit]], rank="chunk_no", heavy=heavy
    )
    return numbered.withColumn("chunk_id", F.concat(F.lit("chunk_"), F.col("chunk_no").cast("string")))


def flag_nested(chunks: DataFrame, emit: list[str], heavy: dict | None = None) -> DataFrame:
    """``nested`` is true when an earlier-ordered chunk of the file covers the range.

    Ordered by start, longest first, every container precedes what it contains, so
    one running maximum replaces the pairwise test.
    """
    order = [F.col("start_line"), F.col("end_line").desc(), *[F.col(c) for c in emit]]
    scanned = scan_within(chunks, ["file"], order, max_before={"_covered": "end_line"}, heavy=heavy)
    return scanned.withColumn(
        "nested", F.coalesce(F.col("_covered") >= F.col("end_line"), F.lit(False))
    ).drop("_covered")


def drop_nested(chunks: DataFrame, emit: list[str], heavy: dict | None = None) -> DataFrame:
    return flag_nested(chunks, emit, heavy).filter(~F.col("nested")).drop("nested")


def flag_nested_prompts(rows: DataFrame, heavy: dict | None = None) -> DataFrame:
    """``prompt_nested`` per chunk row (``file, prompt_id, start_line, end_line``): true when any
    chunk of its prompt lies inside a chunk of another prompt.

    Prompts are cut from chunks in start order, so ids rise with start lines. A
    container in an earlier prompt is found by the running maximum of ends; one in a
    later prompt must start on the same line and end later. All windows share the
    file's partitioning, so rows are shuffled once.
    """
    heavy = heavy_keys(rows, "file") if heavy is None else heavy
    order = [F.col("prompt_id"), F.col("start_line"), F.col("end_line")]
    ahead = scan_within(rows, ["file"], order, max_before={"_before": "end_line"}, heavy=heavy)
    prompt = Window.partitionBy("file", "prompt_id")
    # the running maximum never falls, so its least value in a prompt is what came before it
    ahead = ahead.withColumn("_earlier", F.min(F.coalesce("_before", F.lit(-1))).over(prompt))
    both = scan_within(
        ahead, ["file", "start_line"], [F.col("prompt_id").desc(), F.col("end_line")],
        max_before={"_later": "end_line"}, heavy=heavy,
    )
    inside = (F.col("_earlier") >= F.col("end_line")) | F.coalesce(F.col("_later") > F.col("end_line"), F.lit(False))
    return both.withColumn("prompt_nested", F.bool_or(inside).over(prompt)).drop("_before", "_earlier", "_later")


def drop_nested_prompts(prompts: DataFrame, heavy: dict | None = None) -> DataFrame:
    """``prompts(file, prompt_id, chunks)`` without those ``flag_nested_prompts`` marks."""
    rows = prompts.select("file", "prompt_id", F.inline(F.transform(
        "chunks", lambda c: F.struct(c["start_line"].alias("start_line"), c["end_line"].alias("end_line")))))
    bad = flag_nested_prompts(rows, heavy).filter("prompt_nested").select("file", "prompt_id").distinct()
    return prompts.join(bad, ["file", "prompt_id"], "left_anti")


def batch(chunks: DataFrame, batch_size: int, columns: list[str], carry: list[str] | None = None) -> DataFrame:
    """One row per ``batch_size`` consecutive chunks: ``file, prompt_id, is_batch, chunk_ids, chunks``.

    Groups hold at most ``batch_size`` rows. ``chunks`` carry ``chunk_no``; ``carry``
    names columns that are the same for all chunks of a file.
    """
    carry = carry or []
    size = max(batch_size, 1)
    item = F.struct(*columns)
    grouped = (
        chunks.withColumn("prompt_id", F.floor((F.col("chunk_no") - 1) / size))
        .groupBy("file", "prompt_id", *carry)
        .agg(gather(F.col("chunk_no"), item).alias("chunks"))
    )
    return grouped.select(
        "file", "prompt_id", *carry, F.lit(size > 1).alias("is_batch"),
        F.transform("chunks", lambda c: c["chunk_id"]).alias("chunk_ids"), "chunks",
    )


def count_per_file(files: DataFrame, items: DataFrame, out: str) -> DataFrame:
    """Counts with zero for files that have no items."""
    counts = items.groupBy("file").agg(F.count(F.lit(1)).alias(out))
    return files.select("file").join(counts, "file", "left").withColumn(out, F.coalesce(out, F.lit(0)))


def application_order(prompts: DataFrame) -> DataFrame:
    """``first_line`` to apply bottom-up; sort by file and this column descending."""
    return prompts.withColumn(
        "first_line", F.array_min(F.transform("chunks", lambda c: c["start_line"]))
    )


def with_code(units: DataFrame, files: DataFrame) -> DataFrame:
    """Attach each unit's verbatim lines. The text travels once per file: the units of
    a file (at most a few per line of it) are gathered, joined, and spread again.
    """
    columns = [c for c in units.columns if c != "file"]
    gathered = units.groupBy("file").agg(F.collect_list(F.struct(*columns)).alias("_units"))
    joined = gathered.join(files.select("file", "content"), "file")
    coded = let(
        split_lines(F.col("content")),
        lambda lines: F.transform(
            "_units",
            lambda u: F.struct(
                *[u[c].alias(c) for c in columns],
                slice_lines(lines, u["start_line"], u["end_line"]).alias("code"),
            ),
        ),
    )
    return joined.select("file", F.inline(coded))
