"""Ordered lists from groups of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def gather(key: Column, item: Column) -> Column:
    """Aggregate: items of a group as an array in ``key`` order; items may hold maps."""
    rows = F.collect_list(F.struct(key.alias("k"), item.alias("v")))
    ordered = F.array_sort(
        rows, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
    )
    return F.transform(ordered, lambda r: r["v"])
