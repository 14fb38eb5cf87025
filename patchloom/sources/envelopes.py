"""JSON documents between stages: chunks, prompts, examples, reports.

A document holds at most ``part_rows`` items; a file with more gets several
documents with increasing ``part``, so no row grows with the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from patchloom import schemas
from patchloom.functions.gather import gather

PART_ROWS = 10_000


def chunk_envelopes(chunks: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """``chunks`` carry ``chunk_no`` (1..n per file); metadata is left out when empty."""
    item = F.struct(
        "chunk_id", "type", "name", "start_line", "end_line", "code",
        F.when(F.size("metadata") > 0, F.col("metadata")).alias("metadata"),
    )
    totals = chunks.groupBy("file").agg(F.count(F.lit(1)).alias("total_chunks"))
    parts = (
        chunks.withColumn("part", F.floor((F.col("chunk_no") - 1) / part_rows).cast("int"))
        .groupBy("file", "language", "part")
        .agg(gather(F.col("chunk_no"), item).alias("chunks"))
    )
    return parts.join(totals, "file").select(
        F.col("file").alias("file_name"), "language", "total_chunks", "part",
        "chunks",
    )


def prompt_envelopes(prompts: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """``prompts`` carry ``file, language, prompt_id`` (0..n-1 per file)."""
    item = F.struct("prompt_id", "is_batch", "chunk_ids", "chunks", "prompt")
    totals = prompts.groupBy("file").agg(F.count(F.lit(1)).alias("total_prompts"))
    parts = (
        prompts.withColumn("part", F.floor(F.col("prompt_id") / part_rows).cast("int"))
        .groupBy("file", "language", "part")
        .agg(gather(F.col("prompt_id"), item).alias("prompts"))
    )
    return parts.join(totals, "file").select(
        F.col("file").alias("file_name"), "language", "total_prompts", "part",
        F.current_timestamp().alias("generated_at"), "prompts",
    )


def write_envelopes(envelopes: DataFrame, path: str) -> None:
    envelopes.write.mode("errorifexists").json(path, ignoreNullFields=True)


def read_chunk_envelopes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Chunk rows, and the rejected documents with the reason."""
    text = spark.read.text(path, wholetext=False)
    return parse_chunk_envelopes(text, "value")


def parse_chunk_envelopes(
    documents: DataFrame, text: str, keep: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Chunk rows of valid documents, and the rest with ``reject_reason``; ``keep`` names columns carried along."""
    keep = keep or []
    # behind a generator an expression is evaluated once, however often its value is used
    once = lambda rows, *values: rows.select(*keep, F.inline(F.array(F.struct(*values))))
    parsed = once(
        once(documents, F.col(text)), F.col(text), F.from_json(text, schemas.CHUNK_ENVELOPE, {"mode": "PERMISSIVE"}).alias("_doc"),
        F.get_json_object(text, "$").isNull().alias("_broken"), F.get_json_object(text, "$.chunks").alias("_chunks"))
    reason = (
        F.when(F.col("_doc").isNull() | F.col("_broken"), F.lit("not JSON"))
        .when(F.col("_doc.file_name").isNull(), F.lit("missing key: file_name"))
        .when(F.col("_doc.language").isNull(), F.lit("missing key: language"))
        .when(F.col("_chunks").isNull(), F.lit("missing key: chunks"))
        .when(~F.ltrim("_chunks").startswith("["), F.lit("'chunks' must be an array"))
    )
    checked = parsed.withColumn("reject_reason", reason)
    rows = checked.filter(F.col("reject_reason").isNull()).select(
        *keep, F.col("_doc.file_name").alias("file"), F.col("_doc.language").alias("language"),
        F.inline("_doc.chunks"),
    )
    rejects = checked.filter(F.col("reject_reason").isNotNull()).select(*keep, text, "reject_reason")
    return rows, rejects


def read_prompt_envelopes(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(schemas.PROMPT_ENVELOPE).json(path)
        .select(F.col("file_name").alias("file"), "language", F.inline("prompts"))
    )


def read_examples(spark: SparkSession, path: str | None) -> DataFrame:
    """Example rows with ``position``; none when the file is missing or malformed."""
    from patchloom.sources.corpus import _exists

    schema = f"{schemas.EXAMPLE}, position INT"
    if path is None or not _exists(spark, path):
        return spark.createDataFrame([], schema)
    documents = spark.read.text(path, wholetext=True).select(
        F.from_json("value", schemas.EXAMPLE_FILE, {"mode": "PERMISSIVE"}).alias("d")
    )
    return documents.select(F.posexplode("d.examples").alias("position", "e")).select("e.*", "position")


def parse_reports(reports: DataFrame, text: str = "report") -> DataFrame:
    """Typed report columns; unreadable JSON gives nulls, never an error."""
    return reports.withColumn("doc", F.from_json(text, schemas.REPORT, {"mode": "PERMISSIVE"}))


def check_entry(entry):
    """``STRUCT<passed, message>`` of a check given as an object or as ``[ok, message]``."""
    as_object = F.from_json(entry, "passed BOOLEAN, message STRING")
    as_array = F.from_json(entry, "ARRAY<STRING>")
    is_array = F.ltrim(entry).startswith("[") & (F.size(as_array) >= 2)
    return F.struct(
        F.when(is_array, F.get(as_array, F.lit(0)).cast("boolean"))
        .otherwise(F.coalesce(as_object["passed"], F.lit(True))).alias("passed"),
        F.when(is_array, F.get(as_array, F.lit(1)))
        .otherwise(F.coalesce(as_object["message"], F.lit(""))).alias("message"),
    )
