"""The whole run as tables: files → chunks → prompts → (replies) → files → checks → results → retry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from patchloom.operators import (
    attempts, brace, chunks as chunk_ops, languages, lint, prompts as prompt_ops, python_units, replay, replies as reply_ops,
    rollup, structure,
)
from patchloom.session import cut_lineage
from patchloom.skew import heavy_keys

CHUNK = ["chunk_id", "type", "name", "start_line", "end_line", "code", "metadata"]


@dataclass
class Chunked:
    """Chunks of a corpus, the files that gave none with the reason, and the parsed rows of its Python files."""

    chunks: DataFrame
    rejects: DataFrame
    parsed: DataFrame | None = None


def chunk_corpus(files: DataFrame, nested: bool = False) -> Chunked:
    """``chunks(file, language, chunk_no, chunk_id, type, name, start_line, end_line, code, metadata)``
    from ``files(file, content)`` with unique paths."""
    accepted, rejected = languages.routed(languages.detect(files))
    python = accepted.filter("route = 'syntax'")
    # unit rows feed both the chunks and the rejects: parse once, keep the small result
    parsed = cut_lineage(python_units.parse(python))
    failed = python_units.syntax_status(parsed).filter("NOT ok AND NOT message LIKE 'Compile error%'")
    from_python = python_units.chunk_rows(parsed).withColumn("language", F.lit("python"))
    from_braces = brace.brace_units(accepted.filter("route = 'brace'"), nested=nested).withColumns({
        "emit": F.col("start_line"), "metadata": F.lit(None).cast("map<string,string>"),
    })
    found = from_python.unionByName(from_braces.select(*from_python.columns))
    # a file is one row, so its chunks are as many as its lines: no heavy keys
    numbered = chunk_ops.renumber(found, ["emit"], heavy={}).drop("emit")
    rejects = rejected.select("file", "reject_reason").unionByName(
        failed.select("file", F.col("message").alias("reject_reason"))
    )
    return Chunked(chunk_ops.with_code(numbered, files), rejects, parsed)


def build_prompts(
    chunks: DataFrame, files: DataFrame, examples: DataFrame, batch_size: int = 1,
    templates: DataFrame | None = None,
) -> DataFrame:
    """``file, language, prompt_id, is_batch, chunk_ids, chunks, prompt``."""
    rows = chunk_ops.batch(chunks, batch_size, CHUNK, carry=["language"])
    first = F.get("chunks", F.lit(0))
    rows = prompt_ops.attach_guidance(rows.withColumn("type", first["type"]))
    rows = prompt_ops.attach_example(rows, examples)
    if batch_size > 1:
        made = prompt_ops.batch_prompt(prompt_ops.attach_context(rows, files))
    else:
        rows = prompt_ops.attach_template(rows, templates)
        rows = rows.withColumns({c: first[c] for c in CHUNK if c != "type"})
        made = prompt_ops.single_prompt(prompt_ops.attach_context(rows, files))
    return made.select("file", "language", "prompt_id", "is_batch", "chunk_ids", "chunks", "prompt")


@dataclass
class Applied:
    """Rewritten files, counts per file, and what could not be applied."""

    files: DataFrame
    counts: DataFrame
    missing: DataFrame
    rejected: DataFrame


def apply_replies(
    files: DataFrame, prompts: DataFrame, replies: DataFrame, mode: str = "chunk",
    indent: str = "reference", newline: str = "reference", heavy: dict | None = None,
) -> Applied:
    """Splice ``replies(file, prompt_id, reply)`` into ``files``.

    ``mode="chunk"`` drops nested chunks, ``"prompt"`` drops whole prompts that hold
    one; both before replies are looked at, so an unanswered container still covers
    what lies inside it.
    """
    heavy = heavy_keys(prompts, "file") if heavy is None else heavy
    sent = prompts.select("file", "prompt_id", "is_batch", "chunks")
    expected = sent.select("file", "prompt_id", F.posexplode("chunks").alias("pos", "c")).select(
        "file", "prompt_id", "pos", *[F.col(f"c.{n}").alias(n) for n in ("chunk_id", "start_line", "end_line")])
    if mode == "prompt":
        flagged = chunk_ops.flag_nested_prompts(expected, heavy)
        expected = flagged.filter("NOT prompt_nested").drop("prompt_nested")
    # in prompt mode this settles nesting within one prompt, on original coordinates
    expected = chunk_ops.drop_nested(expected, ["prompt_id", "pos"], heavy)
    # a reply, its prompt and the chunks expected of it meet by file, so a text is dealt out once and spliced where it is
    asked = sent.select("file", "prompt_id", F.struct("is_batch", F.get("chunks", F.lit(0))["chunk_id"].alias("chunk_id")).alias("_sent"))
    wanted = expected.select("file", "prompt_id", F.struct("chunk_id", "start_line", "end_line").alias("_wanted"))
    rows = replies.select("file", "prompt_id", "reply").unionByName(asked, allowMissingColumns=True).unionByName(wanted, allowMissingColumns=True)
    met = rows.filter("file IS NOT NULL AND prompt_id IS NOT NULL").repartition("file").groupBy("file", "prompt_id").agg(
        *[F.collect_list(c).alias(c) for c in ("reply", "_sent", "_wanted")])
    answered = met.select("file", "prompt_id", "_wanted", "_sent", F.explode("reply").alias("reply")).select(
        "file", "prompt_id", "_wanted", "reply", F.inline("_sent"))
    usable, missing = reply_ops.expected_vs_returned(expected, reply_ops.returned_code(answered, ["_wanted"]), "_wanted")
    out, rejected = reply_ops.splice(files, usable.select("file", "start_line", "end_line", "code"), indent, newline)
    counts = reply_ops.apply_counts(prompts, usable)
    return Applied(out, counts, missing.select("file", "prompt_id", "chunk_id"), rejected)


@dataclass
class Validated:
    """Results per file, all checks, and the property rows that failed (null where nothing was run)."""

    results: DataFrame
    checks: DataFrame
    failures: DataFrame | None


def validate(originals: DataFrame, refactored: DataFrame, *args, **options) -> tuple[DataFrame, DataFrame]:
    """Results and checks of ``validate_detail``."""
    done = validate_detail(originals, refactored, *args, **options)
    return done.results, done.checks


def validate_detail(
    originals: DataFrame, refactored: DataFrame, runs: DataFrame | None = None, load_errors: DataFrame | None = None,
    attempt: int = 1, strict: bool = False, properties: bool = True, idempotence: bool = False, shared_only: bool = True,
    known: DataFrame | None = None,
) -> Validated:
    """Results, checks and failed properties for file pairs by relative path.

    ``runs`` are recorded executions (see ``replay``); ``load_errors(file,
    original_error, refactored_error)`` says which modules did not load. ``properties``
    turns the property checks off, ``idempotence`` adds that of a second call; both look at
    functions that are public on both sides, unless ``shared_only`` is off. ``known`` are parsed rows
    of originals (as ``chunk_corpus`` gives them), which are not parsed again. The rate is
    0 where the syntax is broken and 1 where nothing was run or loaded; it is null for
    skipped pairs and where the runs hold no case of the file. Results:
    ``file, status, passed, severity, pass_rate, first_failure, failed_checks, checks``.
    """
    pairs = rollup.pair_files(originals, refactored)
    both = pairs.filter("status IS NULL")
    sides = [F.struct(F.lit("original").alias("side"), F.col("original").alias("content")),
             F.struct(F.lit("refactored").alias("side"), F.col("refactored").alias("content"))]
    if known is None:
        texts, before = both.select("file", F.inline(F.array(*sides))), None
    else:
        there = known.select("file").distinct().withColumn("_known", F.lit(True))
        texts = both.join(there, "file", "left").select(
            "file", F.inline(F.when(F.col("_known"), F.array(sides[1])).otherwise(F.array(*sides))))
        before = known.join(both.select("file"), "file", "left_semi").withColumn("side", F.lit("original"))
    # the unit rows are read several times: parse once, keep the small result
    parsed = cut_lineage(python_units.parse(texts, keep=["side"]))
    if before is not None:
        parsed = parsed.unionByName(before)
    # all that follows goes by file, so rows are dealt out once and stay where they are
    dealt = parsed.repartition("file")
    state = lambda side: F.max(F.when(F.col("side") == side, F.struct("ok", "message")))
    states = dealt.filter(F.col("kind").isNull()).groupBy("file").agg(state("original").alias("_old"), state("refactored").alias("_new"))
    shapes = structure.compare(dealt.filter(F.col("top_level")).withColumn("ord", F.col("def_line")), strict).select(
        "file", F.struct("ok", "message").alias("_shape"))
    rows = lint.with_lint(pairs.select("file", F.col("status").alias("_skip"), "refactored"), "refactored", "_lint").drop("refactored").join(
        states, "file", "left").join(shapes, "file", "left")

    gate = F.coalesce(F.col("_new.ok"), F.lit(False))
    unreadable = ~F.col("_old.ok") & ~F.col("_old.message").like("Compile error%")
    shape_ok = F.when(unreadable, F.lit(False)).otherwise(F.coalesce("_shape.ok", F.lit(True)))
    shape_message = F.when(unreadable, F.concat(F.lit("Cannot parse for AST comparison: "), "_old.message")).otherwise(
        F.coalesce("_shape.message", F.lit(structure.PRESERVED)))
    check = lambda ord_, name, ok, message, when: F.when(when, F.struct(
        F.lit(ord_).alias("ord"), F.lit(name).alias("check"), ok.alias("passed"), message.alias("message")))
    parts = [
        check(0, "syntax", F.col("_new.ok"), F.col("_new.message"), F.col("_new").isNotNull()),
        check(1, "ast_structure", shape_ok, shape_message, gate), check(2, "linting", F.col("_lint.ok"), F.col("_lint.message"), gate)]
    failed, rate = None, F.lit(1.0)
    if runs is not None:
        judged_cases = cut_lineage(replay.verdicts(replay.pair_runs(runs)))
        shared = replay.shared_functions(python_units.public_functions(parsed)) if shared_only else None
        failed = replay.properties(judged_cases, shared=shared).filter("NOT passed" if properties else "false")
        if idempotence:
            again = replay.idempotence(runs, shared=shared)
            failed = failed.unionByName(again.filter("NOT passed").select(failed.columns))
        totals = replay.aggregate(replay.by_function(judged_cases), failed)
        if load_errors is None:
            totals = totals.withColumns({e: F.lit(None).cast("string") for e in ("original_error", "refactored_error")})
        else:
            totals = totals.join(load_errors, "file", "full_outer")
        rows = rollup.functional_check(rows.join(totals, "file", "left"))
        parts.append(check(3, "functional", F.col("ok"), F.col("message"), gate))
        unloaded = F.col("original_error").isNotNull() | F.col("refactored_error").isNotNull()
        rate = F.when(unloaded, F.lit(1.0)).otherwise(F.col("pass_rate"))

    # a file that was skipped has no checks
    listed = rows.select("file", "_skip", rate.alias("_rate"), F.array_compact(F.array(*parts)).alias("_all"))
    checks = listed.select("file", F.lit(attempt).alias("attempt"), F.inline("_all")).withColumnRenamed("passed", "ok")
    ruled = rollup.judged(listed)
    skipped = F.col("_skip").isNotNull()
    broken = F.exists("checks", lambda c: (c["check"] == "syntax") & ~c["passed"])
    unless = lambda c: F.when(~skipped, c)
    results = ruled.select(
        "file", F.lit(attempt).alias("attempt"),
        F.when(skipped, F.lit("SKIP")).otherwise(rollup.status(F.col("passed"))).alias("status"), unless(F.col("passed")).alias("passed"),
        F.when(skipped, F.lit("skip")).otherwise(F.col("severity")).alias("severity"),
        F.bround(F.when(skipped, F.lit(None)).when(broken, F.lit(0.0)).otherwise(F.col("_rate")), 4).alias("pass_rate"),
        F.when(skipped, F.concat(F.lit(rollup.SKIP_ERROR), reply_ops.output_name(F.col("file").cast("string"))))
        .otherwise(F.col("first_failure")).alias("first_failure"),
        unless(F.col("failed_checks")).alias("failed_checks"), unless(F.col("checks")).alias("checks"),
    )
    return Validated(results, checks, failed)


def attempt_row(results: DataFrame) -> DataFrame:
    """``file, val_passed, val_severity, val_pass_rate, val_error`` of one attempt."""
    bad = F.get(F.filter("checks", lambda c: ~c["passed"]), F.lit(0))
    return results.select(
        "file", F.col("passed").alias("val_passed"), F.col("severity").alias("val_severity"),
        F.col("pass_rate").alias("val_pass_rate"), attempts.validation_error(bad["check"], bad["message"]).alias("val_error"),
    )


def retry_prompts(
    prompts: DataFrame, results: DataFrame, failures: DataFrame | None = None, generated: Column | None = None,
) -> DataFrame:
    """Prompts of failed files, each prefixed with what went wrong. Chunks are reused as they are.

    Every failed check and every failed property case is listed, by function, case and
    property; a context is as long as its file has failures. ``generated`` is the time
    shown in the report, by default that of the query.
    """
    failed = results.filter("NOT passed")
    reports = rollup.text_reports(failed, failures, generated).withColumnRenamed("report", "report_text")
    rows = failed.select("file", "severity", "checks").join(reports, "file")
    if failures is None:
        kind = "array<struct<function:string,property:string,message:string>>"
        rows = rows.withColumn("property_failures", F.lit(None).cast(kind))
    else:
        listed = failures.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("func", "case_id", "property", "message"))).alias("_all"))
        listed = listed.select("file", F.transform("_all", lambda f: F.struct(
            f["func"].alias("function"), f["property"].alias("property"), f["message"].alias("message"))).alias("property_failures"))
        rows = rows.join(listed, "file", "left")
    subset = prompts.join(failed.select("file"), "file", "left_semi")
    return prompt_ops.inject_context(subset, prompt_ops.retry_context(rows))
