"""Engine inputs made from the given tables: one derivation per kind of input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from patchloom import config
from patchloom.plans.registry import read

STAGE_OF_EVENT = {"view": "1", "click": "2", "signup": "3", "error": "3.5", "purchase": "4"}
STATUS_OF_EVENT = {
    "view": "queued", "click": "running", "signup": "completed", "error": "failed", "purchase": "cancelled",
}
EXTENSIONS = [ext for ext, _ in config.EXTENSION_LANGUAGE] + [".PY", ".xyz"]


def _lookup(column: str, table: dict[str, str]):
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), F.col(column))


def _pick(number, values: list[str]):
    return F.get(F.array(*[F.lit(v) for v in values]), number.cast("int"))


def stage_lines(events: DataFrame) -> DataFrame:
    """``job_id, ts, seq, line``: a marker per event, labelled on even ids, every 50th unreadable."""
    number = F.when(F.col("event_id") % 50 == 49, F.lit("x")).otherwise(_lookup("event_type", STAGE_OF_EVENT))
    label = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("::"), "event_type")).otherwise(F.lit(""))
    return events.select(
        F.floor(F.col("event_id") / 4).alias("job_id"), "ts", F.col("event_id").alias("seq"),
        F.concat(F.lit("::STAGE::"), number, label, F.lit("\n")).alias("line"),
    )


def status_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.floor(F.col("event_id") / 4).alias("job_id"), "ts", _lookup("event_type", STATUS_OF_EVENT).alias("status")
    )


def done_times(events: DataFrame) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 1000) * 1000
    return events.select(F.floor(F.col("event_id") / 4).alias("job_id"), F.timestamp_micros(us).alias("ts"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, doc_id, content``: path with one of 24 extensions."""
    docs = read(spark, sf_dir, "documents")
    path = F.concat(F.lit("src/"), "source", F.lit("/d"), F.col("doc_id").cast("string"), _pick(F.col("doc_id") % 24, EXTENSIONS))
    return docs.select(path.alias("file"), "doc_id", F.col("text").alias("content"))


def diff_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    changed = F.concat(
        F.replace("text", F.lit("the "), F.lit("THE ")),
        F.when(F.col("doc_id") % 5 == 0, F.lit("\nextra")).otherwise(F.lit("")),
    )
    return docs.select(
        F.col("doc_id").alias("file"), F.col("text").alias("original"),
        F.when(F.col("doc_id") % 7 != 0, changed).alias("refactored"),
    )


LINE_KEY = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk ranges: ``file, start_line, end_line`` and the emit key."""
    items = read(spark, sf_dir, "lineitem")
    start = F.lit(1) + F.col("l_partkey") % 40
    return items.select(
        F.col("l_orderkey").alias("file"), start.cast("int").alias("start_line"),
        (start + F.col("l_suppkey") % 12).cast("int").alias("end_line"), *LINE_KEY,
    )


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Python file per document, its text as comments; every ninth lacks a colon."""
    i = F.col("doc_id").cast("string")
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("    # "), x)), "\n")
    content = F.concat(
        F.lit("class C"), i, F.lit("(Base):\n    def m(self, a):\n        return a\n\n\n@deco\ndef f"), i,
        F.lit("(a, b=1, *args)"), F.when(F.col("doc_id") % 9 == 0, F.lit("")).otherwise(F.lit(":")),
        F.lit("\n"), body, F.lit("\n    return a\n"),
    )
    return read(spark, sf_dir, "documents", "doc_id").select(
        F.concat(F.lit("p/d"), i, F.lit(".py")).alias("file"), "doc_id", content.alias("content")
    )


def brace_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One brace-language file per document, its text in line comments with stray braces."""
    i = F.col("doc_id").cast("string")
    n = F.col("doc_id") % 3
    head = F.when(n == 0, F.concat(F.lit("function f"), i, F.lit("(a) {"))).when(
        n == 1, F.concat(F.lit("func f"), i, F.lit("(a int) {"))
    ).otherwise(F.concat(F.lit("int f"), i, F.lit("(int a) {")))
    second = F.when(n == 0, F.concat(F.lit("class K"), i, F.lit(" {"))).when(
        n == 1, F.concat(F.lit("type K"), i, F.lit(" struct {"))
    ).otherwise(F.concat(F.lit("struct K"), i, F.lit(" {")))
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("  // { "), x)), "\n")
    content = F.concat(
        head, F.lit('\n  if (a) {\n    s = "}";  // }\n  }\n'), body,
        F.lit("\n}\n/* {\n } ' \" */\n"), second, F.lit("\n  m(a) {\n  }\n}\n"),
    )
    return read(spark, sf_dir, "documents", "doc_id").select(
        F.concat(F.lit("b/d"), i).alias("file"), "doc_id",
        F.when(n == 0, F.lit("javascript")).when(n == 1, F.lit("go")).otherwise(F.lit("c")).alias("language"),
        content.alias("content"),
    )


def structure_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of two sides from line items; what changes depends on the order."""
    items = read(spark, sf_dir, "lineitem")
    how = F.col("l_orderkey") % 4
    base = items.select(
        F.col("l_orderkey").alias("file"),
        F.when(F.col("l_returnflag") == "A", F.lit("class")).otherwise(F.lit("function")).alias("kind"),
        F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("name"),
        F.col("l_partkey").alias("ord"), how.alias("how"), "l_linenumber",
        (F.col("l_quantity") % 5).cast("int").alias("positional_args"),
        (F.col("l_linestatus") == "O").alias("has_varargs"), (F.col("l_suppkey") % 2 == 0).alias("has_kwargs"),
        F.lit(False).alias("has_return_ann"), (F.col("l_partkey") % 4).cast("int").alias("method_count"),
        F.lit(0).alias("base_count"),
    )
    both = base.withColumn("side", F.explode(F.array(F.lit("original"), F.lit("refactored"))))
    new = F.col("side") == "refactored"
    return (
        both.filter(~(new & (F.col("how") == 1) & (F.col("l_linenumber") == 1)))
        .withColumn("positional_args", F.when(new & (F.col("how") == 2), F.col("positional_args") + 1).otherwise(F.col("positional_args")))
        .withColumn("name", F.when(new & (F.col("how") == 3) & (F.col("l_linenumber") == 1), F.lit("g1")).otherwise(F.col("name")))
        .drop("how", "l_linenumber")
    )


# Results that are no plain number: remainder of the id to type, text of the original side, text of the others.
RECORDED = {
    0: ("list", '[#, {"a": [#]}]', '[#, {"a": [#]}]'),
    1: ("ndarray", '{"__type__": "ndarray", "dtype": "float64", "shape": [2], "data": [#, 0.5]}',
        '{"data": [#, 0.5000001], "dtype": "float64", "shape": [2], "__type__": "ndarray"}'),
    2: ("list", '[{"__type__": "tuple", "items": [#, true]}]', '[{"items": [#, 1.0], "__type__": "tuple"}]'),
    3: ("set", '[#, "b", 1]', '[1, "b", #]'),
    4: ("dict", '{"x": {"__type__": "set", "items": [#, "c"]}, "y": NaN}', '{"y": NaN, "x": {"items": ["c", #], "__type__": "set"}}'),
    5: ("generator", "<generator object g at 0x7f01>", "<generator object g at 0xAB#>"),
    6: ("ndarray", '{"__type__": "ndarray", "dtype": "int64", "shape": [2], "data": [#, 2]}',
        '{"__type__": "ndarray", "shape": [2], "dtype": "int64", "data": [#, 2]}'),
}
# Texts of the other sides that must not match, by remainder and form.
RECORDED_ODD = {
    (1, 3): '{"__type__": "ndarray", "dtype": "float32", "shape": [2], "data": [#, 0.5]}',
    (1, 4): '{"__type__": "ndarray", "dtype": "float64", "shape": [2, 1], "data": [#, 0.5]}',
    (1, 6): '{"__type__": "ndarray", "dtype": "float64", "shape": [2], "data": [#, 0.501]}',
    (2, 5): "[[#, true]]",
    (3, 7): '[1, "b", #, 0.25]',
    (4, 8): '{"y": null, "x": {"items": ["c", #], "__type__": "set"}}',
}


def recorded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three sides from events; ids decide which results change."""
    e = F.col("event_id")
    cents = F.round(F.col("value") * 100).cast("long")
    events = read(spark, sf_dir, "events", "event_id").select(
        e, F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("file"),
        F.concat(F.lit("f"), (F.col("user_id") % 50).cast("string")).alias("func"),
        "value", (F.col("event_type") != "error").alias("old_ok"), cents.alias("cents"),
    )
    rows = events.withColumn("side", F.explode(F.array(F.lit("original"), F.lit("refactored"), F.lit("repeat"))))
    old = F.col("side") == "original"
    ok = F.when(old, F.col("old_ok")).when(e % 11 == 0, F.lit(False)).otherwise(F.col("old_ok") | (e % 7 == 0))
    error = F.when(old, F.concat(F.lit("ValueError: e"), e.cast("string"))).when(
        e % 11 == 0, F.lit("RuntimeError: boom")).when(e % 3 == 0, F.lit("KeyError: x")).otherwise(F.lit("ValueError: other"))
    shift = F.when(~old & (e % 17 == 0), 1).otherwise(0) + F.when((F.col("side") == "repeat") & (e % 29 == 0), 1).otherwise(0)
    kind, form = e % 13, e % 19
    number = F.when(e % 17 == 1, F.lit(float("nan"))).when(
        ~old & (e % 17 == 2), (F.col("value") + shift) * F.lit(1 + 1e-12)).otherwise(F.col("value") + shift)
    shown = (F.col("cents") + shift * 100).cast("string")
    # texts with # for the number: as the original writes them, and as the other sides do
    texts = F.create_map(*[F.lit(x) for k, (_, first, _) in RECORDED.items() for x in (k, first)])
    others = F.create_map(*[F.lit(x) for k, (_, _, other) in RECORDED.items() for x in (k, other)])
    kinds = F.create_map(*[F.lit(x) for k, (name, _, _) in RECORDED.items() for x in (k, name)])
    odd = F.lit(None).cast("string")
    for (k, f), text in RECORDED_ODD.items():
        odd = F.when((kind == k) & (form == f), text).otherwise(odd)
    written = F.when(old, F.try_element_at(texts, kind.cast("int"))).otherwise(
        F.coalesce(odd, F.try_element_at(others, kind.cast("int"))))
    is_nested = kind < len(RECORDED)
    text = F.when(is_nested, F.replace(written, F.lit("#"), shown)).otherwise(shown)
    type_ = F.coalesce(F.try_element_at(kinds, kind.cast("int")), F.when(~old & (e % 23 == 0), F.lit("int")).otherwise(F.lit("float")))
    return rows.filter(old | (F.col("func") != "f7")).select(
        "file", "func", e.alias("case_id"), "side",
        F.concat(F.lit("["), F.col("cents").cast("string"), F.lit("]")).alias("args"),
        ok.alias("ok"), F.when(ok, text).alias("result"), F.when(ok & ~is_nested, number).alias("result_num"),
        F.when(ok, type_).alias("result_type"), F.when(~ok, error).alias("error"),
    )


def file_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks per document: syntax, structure, lint, and a functional one where a label exists."""
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels")
    longest = F.array_max(F.transform(F.split("text", "\n"), lambda x: F.length(x)))

    def row(ord_: int, name: str, ok, bad: str):
        return F.struct(
            F.lit(ord_).alias("ord"), F.lit(name).alias("check"), ok.alias("ok"),
            F.when(ok, F.lit("fine")).otherwise(F.lit(bad)).alias("message"),
        )

    static = docs.select(
        F.col("doc_id").alias("file"), F.lit(1).alias("attempt"),
        F.inline(F.array(
            row(0, "syntax", F.col("doc_id") % 19 != 0, "SyntaxError at line 1, col 1: bad"),
            row(1, "ast_structure", F.col("n_chars") % 3 != 0, "count changed"),
            row(2, "linting", longest <= 120, "lines too long"),
        )),
    )
    run = labels.join(docs.select("doc_id"), "doc_id", "left_semi").select(
        F.col("doc_id").alias("file"), F.lit(1).alias("attempt"), F.lit(3).alias("ord"),
        F.lit("functional").alias("check"), (F.col("quality") == 1).alias("ok"),
        F.when(F.col("quality") == 1, F.lit("fine")).otherwise(F.lit("1/2 tests passed (50%)")).alias("message"),
    )
    return static.unionByName(run)
