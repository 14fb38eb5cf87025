"""Replies as tables: code extraction, expected ids, splicing, retries, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from patchloom.functions.text import begins, let, strip, unix_newlines
from patchloom.skew import scan_within

# Reply formats.
FENCE = r"(?s)```(?:(?U:\w+))?\n(.*?)\n```"
BLOCK = r'(?s)<chunk id="([^"]+)">(.*?)</chunk>'
RETRIABLE = "429|quota|503"
SERVER_DELAY = r"retrydelay':\s*'(\d+)s'"
# Attempts of a request by default; a parameter of retry_waits.
MAX_ATTEMPTS = 10
# Waits in seconds.
BASE_WAIT_S = 5
SERVER_BUFFER_S = 2
QUOTA_EXTRA_S = 15


def code_block(reply: Column) -> Column:
    """First fenced block, else the whole text; trimmed."""
    # an empty extract is an empty block or none
    return strip(let(F.regexp_extract(reply, FENCE, 1), lambda code: F.when((code != "") | reply.rlike(FENCE), code).otherwise(reply)))


def single_code(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replies with ``code``, and those skipped because nothing was extracted."""
    coded = replies.withColumn("code", code_block(F.col("reply")))
    empty = F.coalesce(F.length("code"), F.lit(0)) == 0
    return coded.filter(~empty), coded.filter(empty)


def _last_blocks(reply: Column) -> Column:
    """``array<struct<chunk_id, from_last, body>>`` of the ``<chunk id>`` blocks; the last of an id wins."""
    ids = F.regexp_extract_all(reply, F.lit(BLOCK), F.lit(1))
    bodies = F.regexp_extract_all(reply, F.lit(BLOCK), F.lit(2))
    pairs = F.arrays_zip(ids.alias("id"), bodies.alias("body"))
    ordered = F.array_sort(F.transform(
        pairs, lambda x, i: F.struct(x["id"].alias("chunk_id"), (-i).alias("from_last"), x["body"].alias("body"))
    ))
    return let(ordered, lambda blocks: F.filter(
        blocks, lambda x, i: (i == 0) | (F.get(blocks, i - 1)["chunk_id"] != x["chunk_id"])
    ))


def batched_blocks(replies: DataFrame) -> DataFrame:
    """``file, prompt_id, chunk_id, code`` from ``<chunk id>`` blocks; the last of an id wins.

    Ids repeat within one reply only, so duplicates are settled inside its row.
    """
    rows = replies.select("file", "prompt_id", F.inline(_last_blocks(F.col("reply"))))
    return rows.select("file", "prompt_id", "chunk_id", code_block(F.col("body")).alias("code"))


def returned_code(replies: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``file, prompt_id, chunk_id, code`` of single replies, as ``single_code`` reads them, and of batched
    ones, as ``batched_blocks`` does. Rows: ``file, prompt_id, reply, is_batch, chunk_id``, the chunk of a
    single reply. All in one pass, so rows stay where they are; a union would deal them out again."""
    carried = ["file", "prompt_id", *(keep or [])]
    single = F.struct("chunk_id", F.lit(0).alias("from_last"), F.col("reply").alias("body"))
    bodies = F.when(F.col("is_batch"), _last_blocks(F.col("reply"))).when(~F.col("is_batch"), F.array(single))
    rows = replies.select(*carried, "is_batch", F.inline(bodies)).withColumn("code", code_block(F.col("body")))
    return rows.filter(F.col("is_batch") | (F.coalesce(F.length("code"), F.lit(0)) > 0)).select(*carried, "chunk_id", "code")


def expected_vs_returned(expected: DataFrame, returned: DataFrame, listed: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks to apply, and expected chunks the reply left out. Where ``returned`` has the expected chunks of
    its prompt in a list ``listed`` of structs with ``chunk_id``, no code travels to meet them."""
    keys = ["file", "prompt_id", "chunk_id"]
    if listed is None:
        return expected.join(returned, keys, "inner"), expected.join(returned, keys, "left_anti")
    others = [c for c in returned.columns if c not in (*keys, listed)]
    met = F.inline(F.transform(
        F.filter(listed, lambda x: x["chunk_id"] == F.col("chunk_id")), lambda x: F.struct(x.alias("_x"))))
    found = returned.select(*keys, *others, met).select("file", "prompt_id", "_x.*", *others)
    return found, expected.join(returned.select(*keys), keys, "left_anti")


def apply_counts(prompts: DataFrame, applied: DataFrame) -> DataFrame:
    """``file, prompts, applied, failed``: no success with prompts present fails the file."""
    wanted = prompts.groupBy("file").agg(F.count(F.lit(1)).alias("prompts"))
    done = applied.groupBy("file").agg(F.count(F.lit(1)).alias("applied"))
    joined = wanted.join(done, "file", "left").withColumn("applied", F.coalesce("applied", F.lit(0)))
    return joined.withColumn("failed", (F.col("applied") == 0) & (F.col("prompts") > 0))


def fix_indent(code: Column, first_line: Column, mode: str = "reference", keep_blank_end: bool = False) -> Column:
    """Lines of ``code`` with the indentation of the replaced first line.

    A final line feed adds no line unless ``keep_blank_end``.

    ``reference`` indents only non-empty lines that start at column 0; ``shift``
    moves the whole block, which keeps body depth when the reply lost it.
    """
    indent = F.regexp_extract(first_line, r"^([ \t\f\x0b\r\n]*)", 1)
    lines = F.split(unix_newlines(code), "\n")
    ends_blank = (code == "") if keep_blank_end else (F.element_at(lines, -1) == "")
    kept = F.when(ends_blank, F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    if mode == "shift":
        return F.transform(kept, lambda x: F.when(x == "", x).otherwise(F.concat(indent, x)))
    return F.transform(kept, lambda x: F.when(begins(x), F.concat(indent, x)).otherwise(x))


_KEEP_ENDS = r"(?<=\n)|(?<=\r)(?!\n)"
# The same for a text whose lines all end with a line feed.
_KEEP_FEEDS = r"(?<=\n)"


def splice(
    files: DataFrame, patches: DataFrame, indent: str = "reference", newline: str = "reference"
) -> tuple[DataFrame, DataFrame]:
    """Apply ``patches(file, start_line, end_line, code)`` to ``files(file, content)``.

    Returns ``files_out(file, content, applied)`` with every file, and the rejected
    patches. Coordinates are those of the original, so order does not matter and no
    line drifts. Patches must be free of nesting (see ``drop_nested``): starts then
    rise strictly, so a file has at most one patch per line and gathering them per
    file is bounded by its own text.

    ``newline="reference"`` ends every line with a line feed; ``"preserve"`` keeps
    terminators and lets a patch end as the lines it replaces did.
    """
    gathered = patches.groupBy("file").agg(
        F.sort_array(F.collect_list(F.struct("start_line", "end_line", "code"))).alias("_patches")
    )
    joined = files.select("file", "content").join(gathered, "file", "left")
    text = F.col("content")
    if newline == "reference":
        text = unix_newlines(text)
    pieces = let(
        F.split(text, _KEEP_FEEDS if newline == "reference" else _KEEP_ENDS),
        lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p),
    )

    def rebuild(lines: Column, patches_: Column) -> Column:
        def valid(x: Column) -> Column:
            return (x["start_line"] >= 1) & (x["end_line"] <= F.size(lines)) & (x["start_line"] <= x["end_line"])

        def stitched(good: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                resume = F.coalesce(F.get(good, i - 1)["end_line"], F.lit(0)) + 1
                before = F.array_join(F.slice(lines, resume, F.greatest(x["start_line"] - resume, F.lit(0))), "")
                new = fix_indent(x["code"], F.try_element_at(lines, x["start_line"]), indent, newline != "reference")
                if newline == "reference":
                    body = F.concat(F.array_join(new, "\n"), F.lit("\n"))
                else:
                    first_end = F.regexp_extract(F.try_element_at(lines, x["start_line"]), r"(\r\n|\n|\r)?\z", 1)
                    inner = F.when(first_end == "", F.lit("\n")).otherwise(first_end)
                    last_end = F.regexp_extract(F.try_element_at(lines, x["end_line"]), r"(\r\n|\n|\r)?\z", 1)
                    body = let(inner, lambda sep: F.concat(F.call_function("array_join", new, sep), last_end))
                return F.concat(before, F.when(F.size(new) > 0, body).otherwise(F.lit("")))

            tail_from = F.coalesce(F.try_element_at(good, F.lit(-1))["end_line"], F.lit(0)) + 1
            tail = F.array_join(F.slice(lines, tail_from, F.greatest(F.size(lines) - tail_from + 1, F.lit(0))), "")
            return F.struct(
                F.concat(F.array_join(F.transform(good, one), ""), tail).alias("content"),
                F.size(good).alias("applied"),
                F.filter(patches_, lambda x: ~valid(x)).alias("bad"),
                F.size(lines).alias("n_lines"),
            )

        return let(F.filter(patches_, valid), stitched)

    built = joined.withColumn(
        "_out",
        F.when(F.col("_patches").isNotNull(), let(pieces, lambda lines: rebuild(lines, F.col("_patches")))),
    )
    out = built.select(
        "file", F.coalesce("_out.content", "content").alias("content"),
        F.coalesce("_out.applied", F.lit(0)).alias("applied"),
    )
    rejected = built.select("file", F.col("_out.n_lines").alias("n_lines"), F.inline("_out.bad")).select(
        "file", "start_line", "end_line", "code",
        F.format_string("Invalid line range [%d, %d] for file with %d lines.", "start_line", "end_line", "n_lines").alias("reason"),
    )
    return out, rejected


def output_name(file: Column) -> Column:
    """``dir/stem.ext`` → ``dir/stem.refactored.ext``."""
    return F.regexp_replace(file, r"([^/\\])(\.[^./\\]*)?\z", "$1.refactored$2")


def retriable(message: Column) -> Column:
    return F.lower(message).rlike(RETRIABLE)


def retry_waits(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """``request_id, outcome, waits, total_wait_s`` from ``request_id, ts, message`` error rows.

    A request is given up after ``max_attempts``, so no later attempt of it counts and a
    group never exceeds that many rows (the rank limit is applied before the shuffle).
    The fold stops at the first fatal message.
    """
    first = Window.partitionBy("request_id").orderBy("ts")
    gathered = (
        attempts.select("request_id", "ts", "message")
        .withColumn("attempt", F.row_number().over(first))
        .filter(F.col("attempt") <= max_attempts)
        .groupBy("request_id")
        .agg(F.sort_array(F.collect_list(F.struct("attempt", "message"))).alias("log"))
    )

    def step(state: Column, row: Column) -> Column:
        message = F.lower(row["message"])
        server = F.regexp_extract(message, SERVER_DELAY, 1)
        wait = (
            F.when(server != "", server.cast("long") + SERVER_BUFFER_S)
            .when(message.contains("quota"), state["base"] + QUOTA_EXTRA_S)
            .otherwise(state["base"])
        )
        grown = F.greatest(state["base"] * 2, F.floor(wait / 2))
        going = ~state["fatal"] & retriable(row["message"])
        return F.struct(
            F.when(going, grown).otherwise(state["base"]).alias("base"),
            (state["fatal"] | ~retriable(row["message"])).alias("fatal"),
            F.when(going, F.concat(state["waits"], F.array(wait))).otherwise(state["waits"]).alias("waits"),
        )

    start = F.struct(
        F.lit(BASE_WAIT_S).cast("long").alias("base"), F.lit(False).alias("fatal"),
        F.array().cast("array<bigint>").alias("waits"),
    )
    folded = gathered.select("request_id", F.aggregate("log", start, step).alias("s"))
    return folded.select(
        "request_id",
        F.when(F.col("s.fatal"), F.lit("fatal"))
        .when(F.size("s.waits") >= max_attempts, F.lit("exhausted"))
        .otherwise(F.lit("waiting")).alias("outcome"),
        F.col("s.waits").alias("waits"),
        F.aggregate("s.waits", F.lit(0).cast("long"), lambda a, x: a + x).alias("total_wait_s"),
    )


def send_schedule(prompts: DataFrame, order: list[Column], delay: float = 2.0) -> DataFrame:
    """``send_no`` and ``send_offset_s`` per prompt of a file; nothing is waited after the last."""
    ranked = scan_within(prompts, ["file"], order, rank="send_no")
    return ranked.withColumn("send_offset_s", (F.col("send_no") - 1) * F.lit(float(delay)))


def prompt_sizes(prompts: DataFrame) -> DataFrame:
    """``file, prompts, chars, longest`` without sending anything."""
    size = F.length("prompt")
    return prompts.groupBy("file").agg(
        F.count(F.lit(1)).alias("prompts"), F.sum(size).alias("chars"), F.max(size).alias("longest")
    )
