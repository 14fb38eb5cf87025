"""Text expressions: lines, slices, cuts, labels, rates, sizes."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for use inside ``body``; keeps lambdas from re-evaluating it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unix_newlines(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def starts(text: Column, *heads: str) -> Column:
    """Whether ``text`` begins with one of ``heads``; no pattern, so no line is decoded for it."""
    return reduce(or_, [text.startswith(h) for h in heads])


def begins(text: Column) -> Column:
    """Whether ``text`` begins with a character that is not white space."""
    return (text != "") & ~starts(text, *" \t\n\x0b\f\r")


def split_lines(text: Column) -> Column:
    """Lines without terminators; a final terminator opens no extra line."""
    # a split at one character needs no pattern
    return let(
        F.when(F.contains(text, F.lit("\r")), F.split(text, "\r\n|\n|\r")).otherwise(F.split(text, "\n")),
        lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts),
    )


def slice_lines(lines: Column, start: Column, end: Column) -> Column:
    """Verbatim text of lines ``start..end`` (1-based, inclusive)."""
    first = F.greatest(start, F.lit(1))
    return F.array_join(F.slice(lines, first, F.greatest(end - first + 1, F.lit(0))), "\n")


# The characters that count as white space when a text is trimmed.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def cut(text: Column, width: int, keep: int | None = None) -> Column:
    """Texts longer than ``width`` become their first ``keep`` characters and an ellipsis."""
    kept = width if keep is None else keep
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, kept), F.lit("…"))).otherwise(text)


def bullets(items: Column, indent: int = 0) -> Column:
    return F.array_join(F.transform(items, lambda item: F.concat(F.lit(" " * indent + "- "), item)), "\n")


def display_name(name: Column, kind: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("<anonymous "), kind, F.lit(">")))


def line_range(start: Column, end: Column) -> Column:
    return F.concat(F.lit("lines "), start.cast("string"), F.lit("–"), end.cast("string"))


def context_note(kind: Column, parent: Column) -> Column:
    """Sentence naming the enclosing class; empty when there is none."""
    return F.when(
        F.coalesce(parent, F.lit("")) != "",
        F.concat(F.lit("This "), kind, F.lit(" is defined inside the `"), parent, F.lit("` class.")),
    ).otherwise(F.lit(""))


def percent(rate: Column, digits: int = 0, half_up: bool = False, absent: str = "—") -> Column:
    """``0.5`` → ``50%``. Reports round half to even, the viewer rounds half up."""
    scaled = rate.cast("double") * 100
    if half_up:
        shown = F.floor(scaled + 0.5).cast("string")
    else:
        shown = F.format_string(f"%.{digits}f", F.bround(scaled, digits))
    return F.when(rate.isNotNull(), F.concat(shown, F.lit("%"))).otherwise(F.lit(absent))


def human_size(n_bytes: Column) -> Column:
    kib, mib = 1024, 1024 * 1024
    return (
        F.when(n_bytes < kib, F.concat(n_bytes.cast("string"), F.lit(" B")))
        .when(n_bytes < mib, F.concat(F.format_string("%.1f", n_bytes / kib), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.2f", n_bytes / mib), F.lit(" MB")))
    )


def fill(template: str, fields: dict[str, Column]) -> Column:
    """Concatenate a template with ``{name}`` places; inserted text is never rescanned."""
    parts = re.split(r"\{(\w+)\}", template)
    pieces = [
        fields[part].cast("string") if i % 2 else F.lit(part)
        for i, part in enumerate(parts)
        if i % 2 or part
    ]
    return F.concat(*pieces)
