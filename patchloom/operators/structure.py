"""Structure comparison of two versions of a file by its top-level units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Issue messages.
PRESERVED = "AST structure preserved"
COUNT_CHANGED = "Top-level {kind} count changed: "
MISSING = "' missing in refactored code"
ARGS_CHANGED = "': positional arg count changed "
VARARGS_CHANGED = "': *args presence changed "
KWARGS_CHANGED = "': **kwargs presence changed "
METHODS_CHANGED = "': method count changed "
ARROW = " → "

# Own messages of the strict option.
RETURNS_CHANGED = "': return annotation presence changed "
BASES_CHANGED = "': base count changed "

FINGERPRINT = [
    "positional_args", "has_varargs", "has_kwargs", "has_return_ann", "method_count", "base_count",
]


def pair_units(units: DataFrame) -> DataFrame:
    """``file, kind, name, ord, old, new`` from top-level units with ``side`` (original, refactored).

    One grouping settles repeated names (the last definition wins, at the place of
    the first) and pairs the sides. Every value travels as one number under its place, so
    the maxima are kept in hash tables and no unit is sorted.
    """
    sides = {"old": F.col("side") == "original", "new": F.col("side") != "original"}
    types = {f.name: f.dataType for f in units.schema.fields}
    low = (1 << 32) - 1

    def placed(name: str) -> Column:
        value = F.coalesce(F.col(name).cast("int").cast("long") + 1, F.lit(0))  # 0 stands for null
        return F.shiftleft(F.col("ord").cast("long"), 32).bitwiseOR(value)

    def value(side: str, name: str) -> Column:
        number = F.col(f"_{side}_{name}").bitwiseAND(F.lit(low))
        return F.when(number > 0, (number - 1).cast("int").cast(types[name])).alias(name)

    grouped = units.groupBy("file", "kind", "name").agg(
        F.min(F.when(sides["old"], F.col("ord"))).alias("ord"),
        *[F.max(F.when(is_side, placed(n))).alias(f"_{side}_{n}") for side, is_side in sides.items() for n in FINGERPRINT])
    return grouped.select("file", "kind", "name", "ord", *[
        F.when(F.col(f"_{side}_{FINGERPRINT[0]}").isNotNull(), F.struct(*[value(side, n) for n in FINGERPRINT])).alias(side) for side in sides])


def _truth(flag: Column) -> Column:
    return F.when(flag, F.lit("True")).otherwise(F.lit("False"))


def _changed(kind: str, text: str, field: str, show=lambda c: c.cast("string")) -> Column:
    old, new = F.col(f"old.{field}"), F.col(f"new.{field}")
    message = F.concat(F.lit(f"{kind} '"), F.col("name"), F.lit(text), show(old), F.lit(ARROW), show(new))
    return F.when(F.col("new").isNotNull() & ~old.eqNullSafe(new), message)


def name_issues(paired: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ``issues``: messages for one unit of the original, in check order."""
    def missing(kind: str) -> Column:
        return F.when(F.col("new").isNull(), F.concat(F.lit(f"{kind} '"), F.col("name"), F.lit(MISSING)))

    function = [
        missing("Function"),
        _changed("Function", ARGS_CHANGED, "positional_args"),
        _changed("Function", VARARGS_CHANGED, "has_varargs", _truth),
        _changed("Function", KWARGS_CHANGED, "has_kwargs", _truth),
    ]
    klass = [missing("Class"), _changed("Class", METHODS_CHANGED, "method_count")]
    if strict:
        function.append(_changed("Function", RETURNS_CHANGED, "has_return_ann", _truth))
        klass.append(_changed("Class", BASES_CHANGED, "base_count"))
    chosen = F.when(F.col("kind") == "function", F.array_compact(F.array(*function))).when(
        F.col("kind") == "class", F.array_compact(F.array(*klass))
    )
    return paired.withColumn("issues", F.when(F.col("old").isNotNull(), chosen))


def compare(units: DataFrame, strict: bool = False) -> DataFrame:
    """``file, ok, message, n_issues``. A changed count is reported alone for its kind.

    After pairing there is one row per distinct name, so the list per file is bounded
    by the names in that file.
    """
    rows = name_issues(pair_units(units), strict)

    def part(kind: str) -> tuple[list[Column], str]:
        is_kind = F.col("kind") == kind
        return [
            F.count_if(is_kind & F.col("old").isNotNull()).alias(f"{kind}_old"),
            F.count_if(is_kind & F.col("new").isNotNull()).alias(f"{kind}_new"),
            F.sort_array(
                F.collect_list(F.when(is_kind & (F.size("issues") > 0), F.struct("ord", "name", "issues")))
            ).alias(f"{kind}_issues"),
        ], kind

    columns = [c for kind in ("function", "class") for c in part(kind)[0]]
    grouped = rows.groupBy("file").agg(*columns)

    def messages(kind: str) -> Column:
        old, new = F.col(f"{kind}_old"), F.col(f"{kind}_new")
        count = F.concat(
            F.lit(COUNT_CHANGED.format(kind=kind)), old.cast("string"), F.lit(ARROW), new.cast("string")
        )
        return F.when(old != new, F.array(count)).otherwise(
            F.flatten(F.transform(F.col(f"{kind}_issues"), lambda x: x["issues"]))
        )

    found = grouped.select("file", F.concat(messages("function"), messages("class")).alias("all"))
    return found.select(
        "file", (F.size("all") == 0).alias("ok"),
        F.when(F.size("all") == 0, F.lit(PRESERVED)).otherwise(F.array_join("all", "; ")).alias("message"),
        F.size("all").alias("n_issues"),
    )
