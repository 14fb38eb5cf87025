"""Positional line diff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from patchloom.functions.text import let


def _rows(original: Column, refactored: Column) -> Column:
    def paired(old: Column, new: Column) -> Column:
        def row(no: Column) -> Column:
            left = F.coalesce(F.get(old, no - 1), F.lit(""))
            right = F.coalesce(F.get(new, no - 1), F.lit(""))
            return F.struct(
                no.alias("line"), left.alias("original"), right.alias("refactored"),
                (left != right).alias("changed"),
            )
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(old), F.size(new))), row)

    rows = let(F.split(original, "\n"), lambda old: let(F.split(refactored, "\n"), lambda new: paired(old, new)))
    return F.when((original != "") & (refactored != ""), rows)


def line_diff(pairs: DataFrame) -> DataFrame:
    """``file, line, original, refactored, changed`` from rows ``file, original, refactored``.

    Both texts sit in one row, so lines are paired in place without a shuffle. A
    missing side counts as an empty line; an empty or null text gives no rows.
    """
    return pairs.select("file", F.inline(_rows(F.col("original"), F.col("refactored"))))


def diff_counts(pairs: DataFrame) -> DataFrame:
    """``file, changed_lines, total_lines`` per pair, counted within the row."""
    rows = _rows(F.col("original"), F.col("refactored"))
    return pairs.select(
        "file",
        let(rows, lambda r: F.struct(
            F.coalesce(F.size(F.filter(r, lambda x: x["changed"])), F.lit(0)).alias("changed_lines"),
            F.when(r.isNull(), 0).otherwise(F.size(r)).alias("total_lines"),
        )).alias("n"),
    ).select("file", F.when(F.col("n.total_lines") == 0, 0).otherwise(F.col("n.changed_lines")).alias("changed_lines"), "n.total_lines")


def unified(diff: DataFrame) -> DataFrame:
    """Changed lines as a ``-`` and a ``+`` row, the others as one plain row."""
    minus = F.struct(F.lit(0).alias("part"), F.lit("-").alias("marker"), F.col("original").alias("text"))
    plus = F.struct(F.lit(1).alias("part"), F.lit("+").alias("marker"), F.col("refactored").alias("text"))
    same = F.struct(F.lit(0).alias("part"), F.lit(" ").alias("marker"), F.col("original").alias("text"))
    return diff.select(
        "file", "line", F.inline(F.when(F.col("changed"), F.array(minus, plus)).otherwise(F.array(same)))
    )
