"""Edge-case inputs per function signature, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from patchloom import config
from patchloom.functions.text import let

DEFAULT_PERCENT = 20
NONE_PERCENT = 15


def spread(*parts: Column) -> Column:
    """A number below 2**32 from a digest of ``parts``; stable across engines."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _edges(kind: Column) -> Column:
    table = F.create_map(*[
        v for name, values in config.EDGE_VALUES.items()
        for v in (F.lit(name), F.array(*[F.lit(x) for x in values]))
    ])
    return F.coalesce(F.try_element_at(table, kind), F.array(F.lit("null")))


def _extra(kind: Column, roll: Column) -> Column:
    """One value besides the fixed edges, for the types that draw one."""
    digits = (roll % 2001 - 1000).cast("string")
    return (
        F.when(kind == "int", digits)
        .when(kind == "float", F.concat(digits, F.lit(".5")))
        .when(kind == "str", F.concat(F.lit('"s'), roll.cast("string"), F.lit('"')))
        .when(kind == "list", F.concat(F.lit("["), (roll % 101).cast("string"), F.lit("]")))
        .when(kind == "dict", F.concat(F.lit('{"k'), (roll % 10000).cast("string"), F.lit('": '), (roll % 10).cast("string"), F.lit("}")))
        .when(kind == "bytes", F.concat(F.lit('"b'), (roll % 1000).cast("string"), F.lit('"')))
        .when(kind == "tuple", F.concat(F.lit("["), (roll % 5).cast("string"), F.lit("]")))
    )


def _scalar(kind: Column, roll: Column, first: Column) -> Column:
    edges = _edges(kind)
    pool = F.when(_extra(kind, roll).isNotNull(), F.concat(edges, F.array(_extra(kind, roll)))).otherwise(edges)
    return F.when(first, F.get(edges, F.lit(0))).otherwise(F.get(pool, (roll % F.size(pool)).cast("int")))


def _balanced(depth: int, but: str) -> str:
    """Text without characters of ``but`` outside brackets, with ``depth`` levels of them."""
    inner = rf"(?:\[{_balanced(depth - 1, '')}\])" if depth else r"(?!)"
    return rf"(?:'[^']*'|\"[^\"]*\"|[^\[\]'\"{but}]|{inner})*+"


def type_depth(declared: Column) -> Column:
    """How deep the brackets of a declared type go."""
    step = lambda s, c: let(s["at"] + F.when(c == "[", 1).when(c == "]", -1).otherwise(0), lambda at: F.struct(
        at.alias("at"), F.greatest(s["most"], at).alias("most")))
    return F.aggregate(F.split(declared, ""), F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")), step, lambda s: s["most"])


def _pieces(text: Column, depth: int, mark: str) -> Column:
    """Parts of ``text`` between marks that stand outside all brackets, trimmed."""
    parts = F.regexp_extract_all(text, F.lit(rf"(?:^|[{mark}])({_balanced(depth, mark)})"), F.lit(1))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def parsed_type(declared: Column, depth: int) -> Column:
    """``STRUCT<outer, args>`` of a declared type: ``Optional[X]`` and ``X | Y`` are unions."""
    def taken(parts: Column) -> Column:
        one = F.get(parts, F.lit(0))
        outer = F.lower(F.regexp_extract(one, r"^(?:typing\.)?(\w+)", 1))
        args = _pieces(F.regexp_extract(one, r"(?s)^[\w.]+\s*\[(.*)\]\s*$", 1), max(depth - 1, 0), ",")
        optional = outer == "optional"
        return F.when(F.size(parts) > 1, F.struct(F.lit("union").alias("outer"), parts.alias("args"))).otherwise(F.struct(
            F.when(optional, "union").otherwise(outer).alias("outer"),
            F.when(optional, F.array_append(args, F.lit("none"))).otherwise(args).alias("args")))

    return let(_pieces(F.coalesce(declared, F.lit("any")), depth, "|"), taken)


def _literal_value(text: Column) -> Column:
    """JSON of one value of a literal type; bare words are strings."""
    bare = F.regexp_replace(text, "^['\"]|['\"]$", "")
    return (
        F.when(text.isin("True", "False"), F.lower(text)).when(text == "None", "null").when(text.rlike(r"^-?\d+(?:\.\d+)?$"), text)
        .otherwise(F.concat(F.lit('"'), F.regexp_replace(bare, r'(["\\\\])', r"\\$1"), F.lit('"'))))


def _value(declared: Column, seed: Column, first: Column, depth: int) -> Column:
    """A value for a declared type, nested up to ``depth`` brackets.

    The type is taken apart level by level: what a level holds becomes a list of types with
    a seed each, all of them get their values by one expression of the level below, and the
    outer type puts them together.
    """
    if depth <= 0:
        return _plain_value(parsed_type(declared, 0), seed, first)

    def level(t: Column) -> Column:
        outer, args = t["outer"], t["args"]
        roll = spread(seed)
        variadic = (outer == "tuple") & (F.element_at(args, -1) == "...")
        length = F.when(first, F.lit(0)).otherwise(roll % F.when((outer == "list") | variadic, 5).otherwise(4)).cast("int")
        positions = F.when(length > 0, F.sequence(F.lit(1), length)).otherwise(F.array().cast("array<int>"))
        child = lambda kind, mark, j, start: F.struct(
            kind.alias("kind"), F.concat_ws("|", seed, F.lit(mark), j.cast("string")).alias("seed"), start.alias("first"))
        element = F.coalesce(F.get(args, F.lit(0)), F.lit("int"))
        items = F.transform(positions, lambda j: child(element, "item", j, F.lit(False)))
        some = F.filter(args, lambda a: ~F.lower(a).isin("none", "nonetype"))
        pick = F.when(first, 0).otherwise(roll % F.greatest(F.size(some), F.lit(1))).cast("int")
        values = F.transform(positions, lambda j: child(F.coalesce(F.get(args, F.lit(1)), F.lit("int")), "item", j, F.lit(False)))
        keys = F.transform(positions, lambda j: child(element, "key", j, F.lit(False)))
        children = (
            F.when(outer.isin("list", "set") | variadic, items).when(outer == "dict", F.concat(values, keys))
            .when(outer == "tuple", F.transform(F.filter(args, lambda a: a != "()"), lambda a, j: child(a, "item", j, first)))
            .when(outer == "union", F.when(F.size(some) > 0, F.array(child(F.get(some, pick), "item", F.lit(0), first)))))
        got = F.transform(children, lambda c: _value(c["kind"], c["seed"], c["first"], depth - 1))
        return let(F.struct(got.alias("got"), length.alias("n")), lambda g: _assembled(t, g["got"], g["n"], some, seed, first))

    return let(parsed_type(declared, depth), lambda t: F.when(
        (F.size(t["args"]) == 0) | (t["outer"] == "literal"), _plain_value(t, seed, first)).otherwise(level(t)))


def _plain_value(t: Column, seed: Column, first: Column) -> Column:
    """A value of a type without arguments, or of a literal one."""
    roll = spread(seed)
    pick = F.when(first, 0).otherwise(roll % F.greatest(F.size(t["args"]), F.lit(1))).cast("int")
    return F.when((t["outer"] == "literal") & (F.size(t["args"]) > 0), _literal_value(F.get(t["args"], pick))).otherwise(
        _scalar(t["outer"], roll, first))


def _assembled(t: Column, got: Column, n: Column, some: Column, seed: Column, first: Column) -> Column:
    outer, args = t["outer"], t["args"]
    listed = lambda parts: F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]"))
    # keys of text are k1, k2, ...; other keys are the text of their value, each once
    quoted = lambda k: F.when(k.startswith('"'), k).otherwise(F.concat(F.lit('"'), F.regexp_replace(k, '"', r'\\"'), F.lit('"')))
    text_keys = F.lower(F.get(args, F.lit(0))) == "str"
    keys = F.when(text_keys, F.transform(F.slice(got, F.lit(1), n), lambda _, j: F.concat(F.lit('"k'), (j + 1).cast("string"), F.lit('"')))).otherwise(
        F.transform(F.slice(got, n + 1, n), quoted))
    pairs = let(keys, lambda ks: F.filter(
        F.transform(F.slice(got, F.lit(1), n), lambda v, j: F.when(F.array_position(ks, F.get(ks, j)) == j + 1, F.concat(F.get(ks, j), F.lit(": "), v))),
        lambda p: p.isNotNull()))
    none = (F.size(some) < F.size(args)) & ~first & (spread(F.concat_ws("|", seed, F.lit("none"))) % 100 < NONE_PERCENT)
    return (
        F.when(outer.isin("list", "tuple"), listed(got)).when(outer == "set", listed(F.array_distinct(got)))
        .when(outer == "dict", F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")))
        .when((outer == "union") & none, "null").when(outer == "union", F.coalesce(F.get(got, F.lit(0)), F.lit("null")))
        .otherwise("null"))


def edge_cases(params: DataFrame, n: int = 6, depth: int | None = None) -> DataFrame:
    """``func, case_no, args`` (JSON list): ``n`` rows per function, row 0 all first edge values.

    ``params``: ``func, ord, param, type, optional, default`` (default as JSON text or
    null). Receivers and variadic parameters are left out. A signature is one
    definition, so its parameters are gathered before rows are multiplied. ``depth`` is how
    deep the brackets of a type go at most; by default one aggregate finds it.
    """
    if depth is None:
        depth = params.agg(F.max(type_depth(F.col("type")))).head()[0] or 0
        depth = max(depth, 1)
    usable = F.when(
        ~F.col("param").isin("self", "cls") & ~F.col("param").startswith("*"),
        F.struct("ord", "param", "type", "optional", "default"),
    )
    signatures = params.groupBy("func").agg(F.sort_array(F.collect_list(usable)).alias("_sig"))
    cases = signatures.select("func", "_sig", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("case_no"))
    first = F.col("case_no") == 0

    def argument(p: Column) -> Column:
        seed = F.concat_ws("|", F.col("func"), p["param"], F.col("case_no").cast("string"))
        chance = lambda label: spread(F.concat_ws("|", seed, F.lit(label))) % 100
        return (
            F.when(~first & p["default"].isNotNull() & (chance("default") < DEFAULT_PERCENT), p["default"])
            .when(~first & F.coalesce(p["optional"], F.lit(False)) & (chance("none") < NONE_PERCENT), F.lit("null"))
            .otherwise(_value(p["type"], seed, first, depth))
        )

    return cases.select(
        "func", "case_no",
        F.concat(F.lit("["), F.array_join(F.transform("_sig", argument), ", "), F.lit("]")).alias("args"),
    )
