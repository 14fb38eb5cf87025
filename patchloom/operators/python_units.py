"""Python files: syntax status and units, one parse per file inside a table function."""

from __future__ import annotations

import ast
import traceback
import warnings
from collections import deque

from pyspark.sql import DataFrame, functions as F

PARSED = (
    "ok BOOLEAN, message STRING, kind STRING, type STRING, name STRING, parent STRING, "
    "top_level BOOLEAN, emit INT, def_line INT, start_line INT, end_line INT, positional_args INT, "
    "has_varargs BOOLEAN, has_kwargs BOOLEAN, has_return_ann BOOLEAN, method_count INT, base_count INT"
)
# Check messages.
SYNTAX_OK = "Syntax OK"
SYNTAX_ERROR = "SyntaxError at line {line}, col {col}: {message}"
PARSE_FAILED = "AST parse failed: {kind}: {message}"
COMPILE_ERROR = "Compile error: {message}"

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _row(ok, message, unit=None):
    blank = dict.fromkeys(
        ("kind", "type", "name", "parent", "top_level", "emit", "def_line", "start_line", "end_line",
         "positional_args", "has_varargs", "has_kwargs", "has_return_ann", "method_count", "base_count")
    )
    return (ok, message, *{**blank, **(unit or {})}.values())


def _describe(node, kind, type_, parent, top_level, emit):
    decorators = [d.lineno for d in node.decorator_list]
    unit = {
        "kind": kind, "type": type_, "name": node.name, "parent": parent, "top_level": top_level,
        "emit": emit, "def_line": node.lineno,
        "start_line": min(decorators) if decorators else node.lineno, "end_line": node.end_lineno,
    }
    if kind == "class":
        unit["method_count"] = sum(isinstance(child, _FUNCTIONS) for child in node.body)
        unit["base_count"] = len(node.bases)
    else:
        unit["positional_args"] = len(node.args.posonlyargs) + len(node.args.args)
        unit["has_varargs"] = node.args.vararg is not None
        unit["has_kwargs"] = node.args.kwarg is not None
        unit["has_return_ann"] = node.returns is not None
    return unit


def _units(tree):
    """Classes with their direct methods, and functions outside every class.

    Breadth first, carrying whether a class lies above, so each node is seen once.
    """
    top = {id(child) for child in tree.body}
    queue, emit = deque([(tree, False)]), 0
    while queue:
        node, in_class = queue.popleft()
        if isinstance(node, ast.ClassDef):
            yield _describe(node, "class", "class", None, id(node) in top, emit)
            emit += 1
            for child in node.body:
                if isinstance(child, _FUNCTIONS):
                    sync = isinstance(child, ast.FunctionDef)
                    yield _describe(child, "method", "method" if sync else "async_method", node.name, False, emit)
                    emit += 1
        elif isinstance(node, _FUNCTIONS) and not in_class:
            sync = isinstance(node, ast.FunctionDef)
            yield _describe(node, "function", "function" if sync else "async_function", None, id(node) in top, emit)
            emit += 1
        inside = in_class or isinstance(node, ast.ClassDef)
        queue.extend((child, inside) for child in ast.iter_child_nodes(node))


@F.udtf(returnType=PARSED)
class ParsePython:
    """One status row per file, then one row per unit; a failure is a status, never an error."""

    def eval(self, file: str, content: str):
        if content is None:
            yield _row(False, "File not found: " + str(file))
            return
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                tree = ast.parse(content, filename=str(file))
                units = list(_units(tree))
            except SyntaxError as error:
                yield _row(False, SYNTAX_ERROR.format(line=error.lineno, col=error.offset, message=error.msg))
                return
            except Exception as error:
                yield _row(False, PARSE_FAILED.format(kind=type(error).__name__, message=error))
                return
            try:
                compile(content, str(file), "exec", dont_inherit=True)
            except Exception as error:
                text = "".join(traceback.format_exception_only(type(error), error))
                yield _row(False, COMPILE_ERROR.format(message=text))
                # the structure is still known
            else:
                yield _row(True, SYNTAX_OK)
        for unit in units:
            yield _row(None, None, unit)


def parse(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``file``, the ``keep`` columns and the ``PARSED`` columns; status rows have no ``kind``."""
    carried = ["file", *(keep or [])]
    rows = files.select(*carried, "content")
    call = ParsePython(F.col("file").cast("string").outer(), F.col("content").outer())
    return rows.lateralJoin(call.alias("p")).select(*carried, "p.*")


def syntax_status(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("kind").isNull()).select("file", "ok", "message")


def units(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("kind").isNotNull()).drop("ok", "message")


def chunk_rows(parsed: DataFrame) -> DataFrame:
    """Unit rows in chunk form: ``file, type, name, start_line, end_line, emit, metadata``."""
    return units(parsed).select(
        "file", "type", "name", "start_line", "end_line", "emit",
        F.when(F.col("parent").isNotNull(), F.create_map(F.lit("parent_class"), F.col("parent"))).alias("metadata"),
    )


def public_functions(unit_rows: DataFrame) -> DataFrame:
    """Top-level functions whose names do not start with an underscore."""
    return unit_rows.filter((F.col("kind") == "function") & F.col("top_level") & ~F.col("name").startswith("_"))


def top_level(unit_rows: DataFrame) -> DataFrame:
    """Top-level functions and classes by name; the last definition of a name wins."""
    columns = [
        "positional_args", "has_varargs", "has_kwargs", "has_return_ann", "method_count", "base_count",
    ]
    first_seen = F.min("def_line").alias("ord")
    return (
        unit_rows.filter(F.col("top_level"))
        .groupBy("file", "kind", "name")
        .agg(first_seen, F.max_by(F.struct(*columns), F.struct("def_line", "emit")).alias("_last"))
        .select("file", "kind", "name", "ord", "_last.*")
    )


def class_method_counts(unit_rows: DataFrame) -> DataFrame:
    """Methods per class name, for unit tables that come without counts."""
    methods = unit_rows.filter(F.col("kind") == "method").groupBy("file", F.col("parent").alias("name"))
    return methods.agg(F.count(F.lit(1)).cast("int").alias("method_count"))
