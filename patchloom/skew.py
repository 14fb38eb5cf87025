"""Ordered scans that hold up when one key owns a large share of the rows.

A plain window over a key puts a whole group in one task. Here the heavy keys are
found by their exact counts. All other keys take the plain window. Heavy keys are
range-partitioned by the order columns; each range is scanned by itself and receives
what the ranges before it add up to. Those carried values are one row per range.
Joins need nothing of this kind: adaptive execution splits their hot keys.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from patchloom.session import cut_lineage

HEAVY_ROWS = 5_000_000
HEAVY_ROWS_CONF = "patchloom.heavyRows"
# More keys than this are matched by a join instead of a list in the plan.
LISTED_KEYS = 1_000


def heavy_rows(df: DataFrame) -> int:
    """Rows from which a group counts as heavy: a session setting or the default."""
    return int(df.sparkSession.conf.get(HEAVY_ROWS_CONF, str(HEAVY_ROWS)))


def heavy_keys(df: DataFrame, key: str) -> dict:
    """``{key: rows}`` of every heavy group, by exact counts: one aggregate over the key
    column. There are at most as many as the rows of the table hold the threshold."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return {r["k"]: r["n"] for r in counts.filter(F.col("n") >= heavy_rows(df)).collect()}


def _parted(df: DataFrame, key: str, heavy: dict) -> tuple[DataFrame, DataFrame]:
    """Rows of the other keys, and rows of the heavy ones."""
    if len(heavy) <= LISTED_KEYS:
        hot = F.coalesce(F.col(key).isin(list(heavy)), F.lit(False))
        return df.filter(~hot), df.filter(hot)
    keys = df.sparkSession.createDataFrame([(k,) for k in heavy], f"`{key}` {df.schema[key].dataType.simpleString()}")
    return df.join(keys, key, "left_anti"), df.join(keys, key, "left_semi").select(df.columns)


def scan_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    rank: str | None = None,
    max_before: dict[str, str] | None = None,
    heavy: dict | None = None,
) -> DataFrame:
    """Add per-group running values: ``rank`` is the row number; ``max_before`` maps
    an output name to a column whose maximum over strictly earlier rows is wanted.

    ``keys[0]`` is the column that may be heavy. ``order`` must be a total order.
    ``heavy`` is the result of ``heavy_keys`` on a cheaper table with the same key,
    which saves running ``df`` for it.
    """
    max_before = max_before or {}
    heavy = heavy_keys(df, keys[0]) if heavy is None else heavy
    light, hot = _parted(df, keys[0], heavy) if heavy else (df, None)

    plain = Window.partitionBy(*keys).orderBy(*order)
    before = plain.rowsBetween(Window.unboundedPreceding, -1)
    scanned = light
    if rank:
        scanned = scanned.withColumn(rank, F.row_number().over(plain).cast("long"))
    for out, value in max_before.items():
        scanned = scanned.withColumn(out, F.max(value).over(before))
    if not heavy:
        return scanned

    ranges = max(2, math.ceil(sum(heavy.values()) / heavy_rows(df)))
    placed = cut_lineage(
        hot.repartitionByRange(ranges, *[F.col(k) for k in keys], *order)
        .withColumn("_range", F.spark_partition_id())
    )
    group = Window.partitionBy(*keys).orderBy("_range")
    earlier = group.rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*keys, "_range").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max(value).alias(f"_m_{out}") for out, value in max_before.items()],
    )
    carried = sums.select(
        *keys,
        "_range",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n_before"),
        *[F.max(f"_m_{out}").over(earlier).alias(f"_c_{out}") for out in max_before],
    )
    same = F.col("_range") == F.col("_c_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    carried = carried.withColumnRenamed("_range", "_c_range")
    for k in keys:
        carried = carried.withColumnRenamed(k, f"_k_{k}")
    # one row per group and range; whether to broadcast it is left to the planner's size check
    joined = placed.join(carried, same, "inner")

    local = Window.partitionBy(*keys, "_range").orderBy(*order)
    local_before = local.rowsBetween(Window.unboundedPreceding, -1)
    if rank:
        joined = joined.withColumn(rank, F.row_number().over(local) + F.col("_n_before"))
    for out, value in max_before.items():
        joined = joined.withColumn(out, F.greatest(F.max(value).over(local_before), F.col(f"_c_{out}")))
    return scanned.unionByName(joined.select(*scanned.columns))
