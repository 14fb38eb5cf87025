"""Line-rule lint: a subset of the usual style rules, evaluated inside each file's row.

Rules about blank lines look at lines that begin a statement: what lies inside a string or
between brackets is neither a blank run nor a definition. One Arrow function finds those
lines in the texts that can hold any.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType

from patchloom.functions.text import begins, let, split_lines, starts, unix_newlines
from patchloom.operators import lexing

MAX_LINE = 120
BLANK_BEFORE_TOP_LEVEL = 2
RULES = ["E302", "E303", "E501", "W291", "W293", "W391"]
BLANK = r"^[ \t\f\x0b]*\z"
STARTS = ("def ", "class ", "async def ", "@")


def _blank(text: Column) -> Column:
    """A pattern is needed only where other white space follows the spaces."""
    rest = F.ltrim(text)
    return (rest == "") | (starts(rest, *"\t\f\x0b") & text.rlike(BLANK))


def _trailing(text: Column) -> Column:
    return reduce(or_, [text.endswith(c) for c in " \t\f\x0b"])


def _violation(rule: str, line: Column, message: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), line.cast("int").alias("line_no"), message.alias("message"))


@F.arrow_udf(ArrayType(BooleanType()))
def continued(text: pa.Array) -> pa.Array:
    """Per line of a Python text, whether it goes on with a statement; null for a null text."""
    found = (lexing.continued_lines("python", t.as_py()).tolist() if t.is_valid else None for t in text)
    return pa.array(list(found), pa.list_(pa.bool_()))


# Texts that can hold a statement of several lines: triple quotes, or a bracket or backslash before a line's end.
_MANY_LINES = r"\x22{3}|\x27{3}|[(\[{][^)\]}\n]*\n|\\\n"


def _continued(content: Column) -> Column:
    text = unix_newlines(content)
    return continued(F.when(text.rlike(_MANY_LINES), text))


def _line_rules(lines: Column) -> Column:
    """Rules that look at one line only."""
    def checks(text: Column, i: Column) -> Column:
        no = i + 1
        none = F.lit(None).cast("struct<rule:string,line_no:int,message:string>")
        return F.array(
            F.when(F.length(text) > MAX_LINE, _violation("E501", no, F.concat(
                F.lit("line too long ("), F.length(text).cast("string"), F.lit(f" > {MAX_LINE} characters)")))).otherwise(none),
            F.when(_trailing(text) & _blank(text), _violation("W293", no, F.lit("blank line contains whitespace")))
            .when(_trailing(text), _violation("W291", no, F.lit("trailing whitespace"))).otherwise(none),
        )
    return F.filter(F.flatten(F.transform(lines, checks)), lambda v: v.isNotNull())


def _blank_rules(lines: Column, going: Column) -> Column:
    """Rules on the blank run before a line, from the list of lines that are not blank or go on."""
    def marked(text: Column, i: Column) -> Column:
        on = F.coalesce(F.get(going, i), F.lit(False))
        return F.struct(
            (i + 1).alias("no"), (begins(text) & ~on).alias("top"),
            (starts(text, *STARTS) & ~on).alias("starts"), (text.startswith("@") & ~on).alias("deco"),
            (text.startswith("#") & ~on).alias("comment"), (_blank(text) & ~on).alias("blank"), on.alias("on"),
        )

    def rules(full: Column, n_lines: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            previous = F.get(full, i - 1)
            gap = x["no"] - F.coalesce(previous["no"], F.lit(0)) - 1
            allowed = F.when(x["top"], 2).otherwise(1)
            after_deco = F.coalesce(previous["deco"], F.lit(False))
            # a comment right above a definition takes its blank lines over
            glued = F.coalesce(previous["comment"] & previous["top"], F.lit(False)) & (gap == 0)
            return (
                F.when(x["on"], F.lit(None))
                .when(gap > allowed, _violation("E303", x["no"], F.concat(
                    F.lit("too many blank lines ("), gap.cast("string"), F.lit(")"))))
                .when(x["starts"] & (i > 0) & ~after_deco & ~glued & (gap < BLANK_BEFORE_TOP_LEVEL), _violation(
                    "E302", x["no"], F.concat(F.lit("expected 2 blank lines, found "), gap.cast("string"))))
            )
        found = F.filter(F.transform(full, one), lambda v: v.isNotNull())
        last = F.coalesce(F.try_element_at(full, F.lit(-1))["no"], F.lit(0))
        tail = F.when(n_lines > last, F.array(_violation("W391", last + 1, F.lit("blank line at end of file"))))
        return F.concat(found, F.coalesce(tail, F.array().cast("array<struct<rule:string,line_no:int,message:string>>")))

    return let(
        F.filter(F.transform(lines, marked), lambda x: ~x["blank"]),
        lambda full: rules(full, F.size(lines)),
    )


def _found(content: Column, going: Column) -> Column:
    """All violations of a text as an array; ``going`` marks lines that go on with a statement."""
    return let(split_lines(content), lambda lines: F.concat(_line_rules(lines), _blank_rules(lines, going)))


def violations(files: DataFrame) -> DataFrame:
    """``file, rule, line_no, message``; no shuffle, every file is read where it lies."""
    read = files.select("file", "content", _continued(F.col("content")).alias("_going"))
    return read.select("file", F.inline(_found(F.col("content"), F.col("_going"))))


def statistics(found: DataFrame) -> DataFrame:
    """Counts per file and rule, per file, and over all (null marks a total)."""
    return found.rollup("file", "rule").agg(F.count(F.lit(1)).alias("n"))


def with_lint(rows: DataFrame, content: str = "content", out: str = "lint") -> DataFrame:
    """Adds ``out``, a struct of ``ok`` and ``message``: one line per violation, by line and rule."""
    text = F.col(content)
    found = rows.withColumn("_going", _continued(text)).withColumn("_found", _found(text, F.col("_going")))
    ordered = F.array_sort(F.transform("_found", lambda v: F.struct(
        v["line_no"].alias("line_no"), v["rule"].alias("rule"), v["message"].alias("message"))))
    shown = F.array_join(F.transform(ordered, lambda v: F.concat(
        F.lit("line "), v["line_no"].cast("string"), F.lit(": "), v["rule"], F.lit(" "), v["message"])), "\n")
    ok = F.size("_found") == 0
    return found.withColumn(out, F.struct(ok.alias("ok"), F.when(ok, F.lit("No lint issues")).otherwise(shown).alias("message"))).drop("_going", "_found")


def lint_check(files: DataFrame) -> DataFrame:
    """``file, ok, message`` of the lint check."""
    return with_lint(files.select("file", "content")).select("file", "lint.ok", "lint.message")
