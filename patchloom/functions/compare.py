"""Value equality across runs: scalars, arrays, maps and nested JSON."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from patchloom.functions.text import let

NUMERIC_TYPES = ["int", "float", "bool"]
CONTAINER_TYPES = ["list", "tuple", "dict", "set", "frozenset", "ndarray"]


def numbers_match(a: Column, b: Column, tol: float = 1e-9) -> Column:
    """NaN equals NaN, infinities exactly, else relative or absolute tolerance; null only equals null."""
    infinite = (F.abs(a) == float("inf")) | (F.abs(b) == float("inf"))
    near = F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * tol, F.lit(tol))
    return (
        F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull())
        .when(F.isnan(a) | F.isnan(b), F.isnan(a) & F.isnan(b))
        .when(infinite, a == b)
        .otherwise(near)
    )


def strip_addresses(text: Column) -> Column:
    return F.regexp_replace(text, " at 0x[0-9a-fA-F]+", "")


def arrays_close(expected: Column, actual: Column, atol: float = 1e-9, rtol: float = 1e-5) -> Column:
    """Equal size and every pair close; NaN pairs are equal."""
    def close(a: Column, b: Column) -> Column:
        infinite = (F.abs(a) == float("inf")) | (F.abs(b) == float("inf"))
        return (
            F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull())
            .when(F.isnan(a) | F.isnan(b), F.isnan(a) & F.isnan(b))
            .when(infinite, a == b)
            .otherwise(F.abs(a - b) <= F.abs(b) * rtol + atol)
        )

    same = (F.size(expected) == F.size(actual)) & F.forall(
        F.zip_with(expected, actual, close), lambda ok: ok
    )
    return F.when(expected.isNull() | actual.isNull(), expected.isNull() & actual.isNull()).otherwise(same)


def keys_equal(a: Column, b: Column) -> Column:
    """Same key set on both maps."""
    left, right = F.map_keys(a), F.map_keys(b)
    return (F.size(F.array_except(left, right)) == 0) & (F.size(F.array_except(right, left)) == 0)


def maps_match(a: Column, b: Column, tol: float = 1e-9) -> Column:
    """Same keys, numeric values that match."""
    return keys_equal(a, b) & F.forall(
        F.map_keys(a), lambda k: numbers_match(F.try_element_at(a, k), F.try_element_at(b, k), tol)
    )


# Recorded values are JSON; what JSON lacks is an object with this key: tuples, sets and
# frozensets (``items``), arrays (``dtype``, ``shape`` and the flat ``data``), bytes (``hex``).
TYPE_KEY = "__type__"
_STRING = r'"(?:[^"\\]|\\.)*+"'
_ATOM = rf'(?:{_STRING}|[^\[\]{{}},:"]++)'
# Stands before NaN and infinities, which canonical JSON holds as strings.
_NUMERAL_MARK = "\ue000"
_LOOSE = r"-?Infinity|NaN"


def _balanced(depth: int) -> str:
    """What may stand between brackets, with ``depth`` more levels of them inside."""
    if not depth:
        return rf"(?:{_ATOM}|[,:])*+"
    inner = _balanced(depth - 1)
    return rf"(?:{_ATOM}|[,:]|\[{inner}\]|\{{{inner}\}})*+"


_INNER = _balanced(3)
_ELEMENT = rf"{_ATOM}|\[{_INNER}\]|\{{{_INNER}\}}"
_ARRAY = rf'\{{"{TYPE_KEY}":"ndarray","data":\[((?:{_STRING}|[^\]"])*+)\],"dtype":({_STRING}),"shape":\[([^\]]*+)\]\}}'
_SET = rf'\{{"{TYPE_KEY}":"((?:frozen)?set)","items":\[({_INNER})\]\}}'
# Arrays and sets stay whole, as their parts compare by rules of their own.
_TOKEN = rf"{_ARRAY}|{_SET}|{_STRING}|[^\[\]{{}},:\"]++|[\[\]{{}},:]"
_NUMBER = r"^(?:-?[0-9]|true$|false$)"


def _parts(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def canonical_json(text: Column) -> Column:
    """JSON without blanks and with sorted keys; null where the text is none."""
    loose = F.array_join(F.transform(_parts(text, rf"{_STRING}|{_LOOSE}|[^\"NI-]++|[NI-]"), lambda t: F.when(
        t.rlike(rf"^(?:{_LOOSE})$"), F.concat(F.lit('"' + _NUMERAL_MARK), t, F.lit('"'))).otherwise(t)), "")
    plain = F.when(text.rlike(_LOOSE), loose).otherwise(text)
    return F.to_json(F.try_parse_json(plain))


def _as_number(token: Column) -> Column:
    return F.when(token == "true", 1.0).when(token == "false", 0.0).otherwise(token.try_cast("double"))


def _sorted_set(token: Column) -> Column:
    """Elements in order, numbers in one form, as 1, 1.0 and true are equal elements."""
    shown = lambda e: F.when(e.rlike(_NUMBER), _as_number(e).cast("string")).otherwise(e)
    return F.array_sort(F.array_distinct(F.transform(_parts(F.regexp_extract(token, _SET, 2), _ELEMENT), shown)))


def _array_numbers(token: Column) -> Column:
    flat = F.regexp_replace(F.regexp_extract(token, _ARRAY, 1), f'["{_NUMERAL_MARK}]', "")
    return F.transform(F.split(flat, ","), lambda x: _as_number(x))


def array_values_match(expected: Column, actual: Column, tol: float = 1e-9) -> Column:
    """Two recorded arrays: equal shape and dtype; floating data close, other data equal."""
    same = lambda group: F.regexp_extract(expected, _ARRAY, group) == F.regexp_extract(actual, _ARRAY, group)
    floating = F.regexp_extract(expected, _ARRAY, 2).startswith('"float')
    close = arrays_close(_array_numbers(expected), _array_numbers(actual), tol)
    return same(2) & same(3) & (same(1) | (floating & close))


def _token_match(x: Column, y: Column, tol: float) -> Column:
    return (
        F.when(x == y, F.lit(True))
        .when(x.rlike(_NUMBER) & y.rlike(_NUMBER), numbers_match(_as_number(x), _as_number(y), tol))
        .when(x.rlike(f"^{_ARRAY}$") & y.rlike(f"^{_ARRAY}$"), array_values_match(x, y, tol))
        .when(x.rlike(f"^{_SET}$") & y.rlike(f"^{_SET}$"),
              (F.regexp_extract(x, _SET, 1) == F.regexp_extract(y, _SET, 1)) & (_sorted_set(x) == _sorted_set(y)))
        .otherwise(F.lit(False))
    )


def nested_json_match(a: Column, b: Column, unordered: Column, tol: float = 1e-9) -> Column:
    """Deep equality of JSON texts of any depth; null where either side is null.

    Both texts are brought to one form and cut into tokens, which must agree one by one;
    so mappings compare by key, numbers by value, and everything else by place and type.
    ``unordered`` lists are sets. Texts that are no JSON compare as they are.
    """
    as_set = lambda c: F.concat(F.lit(f'{{"{TYPE_KEY}":"set","items":'), c, F.lit("}"))
    form = lambda text: let(canonical_json(text), lambda c: F.when(unordered & c.startswith("["), as_set(c)).otherwise(c))

    def compared(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        return F.when(x.isNull() | y.isNull(), F.lit(False)).otherwise((F.size(x) == F.size(y)) & F.forall(
            F.zip_with(x, y, lambda s, t: _token_match(s, t, tol)), lambda ok: ok))

    tokens = F.struct(_parts(form(a), _TOKEN).alias("x"), _parts(form(b), _TOKEN).alias("y"))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(a == b, F.lit(True)).otherwise(let(tokens, compared))


def results_match(
    e_type: Column, e_text: Column, e_num: Column,
    a_type: Column, a_text: Column, a_num: Column,
    nested: bool = True,
) -> Column:
    """Semantic equality of two recorded results (type tag, text, number).

    Numbers compare across int, float and bool. Other types must agree; generator
    and coroutine texts compare without addresses; containers and arrays compare deeply
    when ``nested``.
    """
    e_none, a_none = F.coalesce(e_type == "NoneType", F.lit(True)), F.coalesce(a_type == "NoneType", F.lit(True))
    scalar = strip_addresses(e_text).eqNullSafe(strip_addresses(a_text))
    plain = (
        F.when(e_none | a_none, e_none & a_none)
        .when(e_type.isin(NUMERIC_TYPES) & a_type.isin(NUMERIC_TYPES), numbers_match(e_num, a_num))
        .when(e_type != a_type, F.lit(False))
        .when(e_type.isin("generator", "coroutine"), scalar)
    )
    if not nested:
        return plain.otherwise(e_text.eqNullSafe(a_text))
    deep = e_type.isin(CONTAINER_TYPES) & (e_type == a_type)
    compared = nested_json_match(
        F.when(deep, e_text), F.when(deep, a_text), F.coalesce(e_type.isin("set", "frozenset"), F.lit(False))
    )
    return plain.when(deep, F.coalesce(compared, F.lit(False))).otherwise(e_text.eqNullSafe(a_text))


def error_class(error: Column) -> Column:
    """Exception class name: the text before the first colon."""
    first = F.substring_index(F.coalesce(error, F.lit("")), ":", 1)
    return F.trim(F.substring_index(first, "\\n", 1))
