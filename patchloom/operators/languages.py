"""Language detection and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from patchloom import config


def extension(path: Column) -> Column:
    """Lower-cased suffix with its dot; names that only start with a dot have none."""
    return F.lower(F.regexp_extract(path, r"[^/\\.][^/\\]*?(\.[^./\\]+)\z", 1))


def with_overrides(base: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``base`` replaced per key by ``overrides`` (column ``seq``: the last one wins)."""
    ranked = base.withColumn("seq", F.lit(-1).cast("long")).unionByName(
        overrides.withColumn("seq", F.col("seq").cast("long"))
    )
    last = Window.partitionBy(*keys).orderBy(F.col("seq").desc())
    return ranked.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r", "seq")


def detect(files: DataFrame, extensions: DataFrame | None = None) -> DataFrame:
    """Add ``ext`` and ``language`` (null when the extension is unknown)."""
    known = extensions if extensions is not None else config.extensions(files.sparkSession)
    return files.withColumn("ext", extension(F.col("file"))).join(known, "ext", "left")


def routed(files: DataFrame, routes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Files with a ``route``, and the rest with ``reject_reason``."""
    known = routes if routes is not None else config.parser_routes(files.sparkSession)
    tagged = files.join(known, "language", "left")
    accepted = tagged.filter(F.col("route").isNotNull())
    reason = F.when(
        F.col("language").isNull(), F.concat(F.lit("Unsupported file extension '"), F.col("ext"), F.lit("'"))
    ).otherwise(F.concat(F.lit("No parser registered for language '"), F.col("language"), F.lit("'")))
    rejected = tagged.filter(F.col("route").isNull()).withColumn("reject_reason", reason).drop("route")
    return accepted, rejected
