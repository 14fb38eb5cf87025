"""Units of languages with blocks: start patterns, and the blocks that the lexers find.

Everything happens inside the file's row: start lines are matched by built-in pattern
functions, one Arrow function lexes the text and gives each start its end line, and only
units become rows. Nothing is shuffled.
"""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from patchloom import config
from patchloom.functions.text import split_lines, unix_newlines
from patchloom.operators import lexing


def match_line(
    language: Column, line: Column, patterns: list[tuple] | None = None, keep_control_words: bool = False
) -> Column:
    """``STRUCT<type, name>`` of the first pattern that fits, else null.

    Patterns are literals, so each is compiled once per task. Those of one language stand
    together, and a known one is tried only where the line holds what it needs.
    """
    parts = []
    for languages, some in groupby(patterns or config.UNIT_PATTERNS, key=lambda p: p[0]):
        found = F
        for _, kind, pattern, group in some:
            regex = "(?U)" + pattern
            name = F.nullif(F.regexp_extract(line, regex, group), F.lit(""))
            fits = line.rlike(regex)
            for text in reversed(config.UNIT_NEEDS.get(pattern, [])):
                fits = F.contains(line, F.lit(text)) & fits
            if kind == "method" and not keep_control_words:
                fits = fits & ~F.coalesce(name, F.lit("")).isin(*config.CONTROL_WORDS)
            found = found.when(fits, F.struct(F.lit(kind).alias("type"), name.alias("name")))
        parts.append(F.when(language.isin(*languages), found))
    return F.coalesce(*parts)


def _found(patterns: list[tuple] | None, keep_control_words: bool) -> Column:
    """Lines of the file that open a unit, as ``array<struct<line_no, unit>>``."""
    def found(text: Column, i: Column) -> Column:
        unit = match_line(F.col("language"), text, patterns, keep_control_words)
        return F.struct((i + 1).alias("line_no"), unit.alias("unit"))

    return F.filter(F.transform(split_lines(F.col("content")), found), lambda x: x["unit"].isNotNull())


def unit_starts(files: DataFrame, patterns: list[tuple] | None = None, keep_control_words: bool = False) -> DataFrame:
    """``file, language, line_no, type, name`` of lines that open a unit.

    Lines are matched inside the file's row, so each is tried once and only hits become rows.
    """
    hits = _found(patterns, keep_control_words)
    return files.select("file", "language", F.inline(hits)).select("file", "language", "line_no", "unit.type", "unit.name")


_END = StructType([StructField("end_line", IntegerType()), StructField("inside", BooleanType()), StructField("masked", BooleanType())])
_MARKS = StructType([StructField("open_literal", BooleanType()), *[StructField(n, IntegerType()) for n in ("opens", "closes", "unclosed")]])


@F.arrow_udf(ArrayType(_END))
def unit_ends(language: pa.Array, text: pa.Array, lines: pa.Array) -> pa.Array:
    """Per start line: the line of the closing mark (null if there is none), whether the unit lies
    inside an earlier one, whether the line begins inside a literal or comment."""
    kind = pa.list_(pa.struct([("end_line", pa.int32()), ("inside", pa.bool_()), ("masked", pa.bool_())]))
    found = (
        lexing.bodies(k.as_py(), t.as_py() or "", n.as_py() or []) if k.is_valid and k.as_py() in lexing.RULES else []
        for k, t, n in zip(language, text, lines))
    return pa.array([[{"end_line": e, "inside": i, "masked": m} for e, i, m in one] for one in found], kind)


@F.arrow_udf(_MARKS)
def block_marks(language: pa.Array, text: pa.Array) -> pa.Array:
    """Whether a literal or comment never ends, and how many block marks there are."""
    out = []
    for k, t in zip(language, text):
        found = lexing.lex(k.as_py(), t.as_py() or "") if k.is_valid and k.as_py() in lexing.RULES else None
        if found is None:
            out.append(None)
            continue
        opens = found.step > 0
        out.append({
            "open_literal": found.open, "opens": int(opens.sum()), "closes": int((~opens).sum()),
            "unclosed": int((lexing.partners(found.step)[opens] < 0).sum())})
    return pa.array(out, pa.struct([("open_literal", pa.bool_()), ("opens", pa.int32()), ("closes", pa.int32()), ("unclosed", pa.int32())]))


def brace_units(
    files: DataFrame,
    patterns: list[tuple] | None = None,
    nested: bool = False,
    keep_control_words: bool = False,
    keep_masked: bool = False,
) -> DataFrame:
    """``file, language, type, name, start_line, end_line`` of units with a closed body.

    With ``nested=False`` units inside an earlier one are dropped; with ``keep_masked=False``
    lines inside literals and comments start no unit.
    """
    text = unix_newlines(F.col("content"))
    starts = files.select("file", "language", text.alias("_text"), _found(patterns, keep_control_words).alias("_starts"))
    # files without a start line need no lexing; a filter here would look for the lines once more
    ended = starts.withColumn("_ends", unit_ends(
        "language", F.when(F.size("_starts") > 0, F.col("_text")), F.transform("_starts", lambda s: s["line_no"])))
    units = F.zip_with("_starts", "_ends", lambda s, e: F.struct(
        s["unit"]["type"].alias("type"), s["unit"]["name"].alias("name"), s["line_no"].alias("start_line"), e["end_line"].alias("end_line"),
        e["inside"].alias("_inside"), e["masked"].alias("_masked")))
    rows = ended.select("file", "language", F.inline(units)).filter("end_line IS NOT NULL")
    if not keep_masked:
        rows = rows.filter("NOT _masked")
    if not nested:
        rows = rows.filter("NOT _inside")
    return rows.drop("_inside", "_masked")


def open_literals(files: DataFrame) -> DataFrame:
    """``file, open_literal``: files with a literal or block comment that never ends."""
    marks = block_marks("language", unix_newlines(F.col("content")))
    return files.select("file", F.coalesce(marks["open_literal"], F.lit(False)).alias("open_literal"))


def block_balance(files: DataFrame) -> DataFrame:
    """``file, language, opens, closes, unclosed``: block marks outside literals and comments."""
    marks = block_marks("language", unix_newlines(F.col("content")))
    return files.select("file", "language", marks.alias("m")).select("file", "language", "m.opens", "m.closes", "m.unclosed")
