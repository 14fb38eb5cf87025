"""Hand-worked cases for scalar rules and operators."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.functions import compare, text
from patchloom.operators import chunks, inputs, jobs, languages, replies, rollup


def one(spark, column):
    return spark.range(1).select(column.alias("v")).head()["v"]


@pytest.mark.parametrize("value, expected", [
    ("", []), ("\n", [""]), ("a", ["a"]), ("a\n", ["a"]), ("a\n\n", ["a", ""]), ("a\r\nb\rc\n", ["a", "b", "c"]),
    ("x\fy\u2028z", ["x\fy\u2028z"]),
])
def test_split_lines(spark, value, expected):
    assert one(spark, text.split_lines(F.lit(value))) == expected


@pytest.mark.parametrize("reply, code", [
    ("x ```py\nA\n``` y", "A"), ("  no fence \n", "no fence"), ("```c++\nA\n```", "```c++\nA\n```"),
    ("```\n  A\n  B\n```\n```\nC\n```", "A\n  B"), ("```\n\n```", ""),
])
def test_code_block(spark, reply, code):
    assert one(spark, replies.code_block(F.lit(reply))) == code


def test_batched_blocks_last_wins(spark, rows):
    reply = (
        '<chunk id="chunk_1">\none\n</chunk>noise<chunk id="chunk_2">```py\ntwo\n```</chunk>\n'
        '<chunk id="chunk_1">  again  </chunk>'
    )
    df = spark.createDataFrame([("f", 0, reply)], "file STRING, prompt_id INT, reply STRING")
    assert rows(replies.batched_blocks(df), "chunk_id", "code") == [("chunk_1", "again"), ("chunk_2", "two")]


def spans(spark, pairs):
    data = [("f", i, s, e) for i, (s, e) in enumerate(pairs)]
    return spark.createDataFrame(data, "file STRING, emit INT, start_line INT, end_line INT")


@pytest.mark.parametrize("pairs, kept", [
    ([(1, 10), (2, 5), (2, 5), (6, 12)], [0, 3]), ([(3, 7), (3, 7)], [0]), ([(2, 4), (1, 9), (9, 9), (10, 11)], [1, 3]),
])
def test_containment(spark, pairs, kept):
    got = chunks.drop_nested(spans(spark, pairs), ["emit"])
    assert sorted(r["emit"] for r in got.collect()) == kept


def test_prompt_mode_drops_whole_batch(spark, rows):
    item = "array<struct<start_line:int,end_line:int>>"
    data = [("f", 0, [(1, 3), (5, 9)]), ("f", 1, [(6, 7), (20, 30)]), ("f", 2, [(40, 50)]), ("f", 3, [(40, 60)]), ("f", 4, [(40, 60)])]
    df = spark.createDataFrame(data, f"file STRING, prompt_id INT, chunks {item}")
    assert rows(chunks.drop_nested_prompts(df), "prompt_id") == [(0,), (3,)]


@pytest.mark.parametrize("a, b, same", [
    (float("nan"), float("nan"), True), (1.0, 1.0, True), (float("inf"), float("-inf"), False), (1.0, 1.0 + 1e-12, True),
    (1.0, 1.001, False), (None, 0.0, False), (None, None, True), (float("inf"), 1.0, False),
])
def test_numbers(spark, a, b, same):
    value = lambda x: F.lit(x).cast("double")
    assert one(spark, compare.numbers_match(value(a), value(b))) is same


@pytest.mark.parametrize("left, right, same", [
    (("bool", "True", 1.0), ("float", "1.0", 1.0), True), (("list", "[1]", None), ("tuple", "[1]", None), False),
    (("NoneType", None, None), ("int", "0", 0.0), False), (("str", "a", None), ("str", "a", None), True),
    (("generator", "<g at 0x7f01>", None), ("generator", "<g at 0xAB>", None), True),
    (("list", '[1, {"a": [NaN, 2.0]}]', None), ("list", '[1.0, {"a": [NaN, 2.0000000000001]}]', None), True),
    (("dict", '{"a": 1}', None), ("dict", '{"b": 1}', None), False), (("set", "[1, 2]", None), ("set", "[2, 1]", None), True),
    (("list", "[1, 2]", None), ("list", "[2, 1]", None), False),
])
def test_results(spark, left, right, same):
    schema = "id INT, at STRING, a STRING, an DOUBLE, bt STRING, b STRING, bn DOUBLE"
    df = spark.createDataFrame([(0, *left, *right)], schema)
    c = F.col
    assert df.select(compare.results_match(c("at"), c("a"), c("an"), c("bt"), c("b"), c("bn"))).head()[0] is same


def typed(value):
    """Recorded form of a value, with tags for what JSON lacks."""
    if isinstance(value, (tuple, set, frozenset)):
        return {"items": [typed(v) for v in value], "__type__": type(value).__name__}
    if isinstance(value, np.ndarray):
        return {"__type__": "ndarray", "dtype": str(value.dtype), "shape": list(value.shape), "data": value.ravel().tolist()}
    if isinstance(value, list):
        return [typed(v) for v in value]
    if isinstance(value, dict):
        return {k: typed(v) for k, v in value.items()}
    return value


def equal(a, b):
    """What two results must satisfy to count as equal, value by value."""
    number = (int, float)
    if a is None or b is None:
        return a is b
    if isinstance(a, number) and isinstance(b, number):
        return (a != a and b != b) or a == b or (math.isfinite(a) and math.isfinite(b) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))
    if type(a) is not type(b):
        return False
    if isinstance(a, np.ndarray):
        if a.shape != b.shape or a.dtype != b.dtype:
            return False
        return bool(np.allclose(a, b, atol=1e-9, equal_nan=True)) if a.dtype.kind == "f" else bool(np.array_equal(a, b))
    if isinstance(a, (list, tuple)):
        return len(a) == len(b) and all(equal(x, y) for x, y in zip(a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(equal(a[k], b[k]) for k in a)
    return a == b


def random_value(rng, depth=3):
    kind = rng.choice(["int", "float", "str", "bool", "none", "nan", "array", "set"] + ["list", "tuple", "dict"] * (depth > 0))
    inner = lambda: random_value(rng, depth - 1)
    return {
        "int": lambda: rng.randint(-3, 3), "float": lambda: rng.choice([0.5, 1.0, -2.0, 1e20, 1e-12]), "bool": lambda: rng.random() < 0.5,
        "str": lambda: rng.choice(["", "a", 'q"[{', "NaN", "1", "é\\\n", "\"__type__\":\"set\""]), "none": lambda: None,
        "nan": lambda: rng.choice([float("nan"), float("inf"), float("-inf")]),
        "array": lambda: np.array([rng.choice([0.5, 1.5, float("nan"), 2.0]) for _ in range(4)], rng.choice(["float64", "float32"])).reshape(
            rng.choice([(4,), (2, 2)])) if rng.random() < 0.7 else np.array([1, rng.randint(1, 2)]),
        "set": lambda: {rng.choice([1, 2, "b", "]", (1, "x"), 2.5, True]) for _ in range(3)},
        "list": lambda: [inner() for _ in range(rng.randint(0, 3))], "tuple": lambda: tuple(inner() for _ in range(rng.randint(0, 3))),
        "dict": lambda: {rng.choice("abc"): inner() for _ in range(rng.randint(0, 3))},
    }[kind]()


def changed(rng, value):
    """The same value, written or built in another way, or nearly the same."""
    if isinstance(value, dict):
        keys = list(value)
        rng.shuffle(keys)
        return {k: changed(rng, value[k]) for k in keys}
    if isinstance(value, (list, tuple)):
        kind = type(value) if rng.random() < 0.95 else (list if type(value) is tuple else tuple)
        return kind(changed(rng, v) for v in value)
    if isinstance(value, set):
        return set(sorted(value, key=lambda v: rng.random()))
    if isinstance(value, np.ndarray):
        return rng.choice([value, value, value.reshape(-1, 1), value + np.array(1e-8, value.dtype) if value.dtype.kind == "f" else value,
                           value.astype("float32") if value.dtype == "float64" else value])
    if isinstance(value, float):
        return rng.choice([value, value, value * (1 + 1e-12), value + 1e-5])
    return rng.choice([value] * 8 + [random_value(rng, 0)])


def test_nested_values_equal_python(spark):
    rng = random.Random(11)
    pairs = []
    for _ in range(600):
        a = random_value(rng)
        pairs.append((a, changed(rng, a) if rng.random() < 0.8 else random_value(rng)))
    shown = lambda v: json.dumps(typed(v), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
    df = spark.createDataFrame([(k, shown(a), shown(b)) for k, (a, b) in enumerate(pairs)], "k INT, a STRING, b STRING")
    got = {r["k"]: r["same"] for r in df.select("k", compare.nested_json_match(F.col("a"), F.col("b"), F.lit(False)).alias("same")).collect()}
    wrong = [(shown(a), shown(b), got[k]) for k, (a, b) in enumerate(pairs) if got[k] != equal(a, b)]
    assert not wrong, wrong[:3]
    assert 100 < sum(got.values()) < 500


def fits(tree, value):
    """Whether a JSON value is one of a type, given as a tree."""
    if isinstance(tree, str):
        return {"int": lambda v: type(v) is int, "str": lambda v: type(v) is str, "bool": lambda v: type(v) is bool, "none": lambda v: v is None,
                "float": lambda v: type(v) in (int, float)}[tree](value)
    kind, *parts = tree
    if kind in ("list", "set"):
        return type(value) is list and all(fits(parts[0], v) for v in value)
    if kind == "tuple":
        return type(value) is list and len(value) == len(parts) and all(map(fits, parts, value))
    if kind == "dict":
        return type(value) is dict and all(fits(parts[1], v) and (parts[0] == "str" or fits(parts[0], json.loads(k))) for k, v in value.items())
    if kind == "literal":
        return value in parts
    return any(fits(p, value) for p in parts)


@pytest.mark.parametrize("declared, tree", [
    ("list[list[int]]", ("list", ("list", "int"))), ("Tuple[int, ...]", ("list", "int")), ("tuple[()]", ("tuple",)),
    ("Dict[int, List[str]]", ("dict", "int", ("list", "str"))), ("Optional[Union[int, str]]", ("union", "int", "str", "none")),
    ("int | list[str | None] | None", ("union", "int", ("list", ("union", "str", "none")), "none")),
    ("dict[tuple[str, int], bool]", ("dict", ("tuple", "str", "int"), "bool")), ("set[tuple[int, int]]", ("set", ("tuple", "int", "int"))),
    ("Literal['a|b', 'c\"d', -2, False, None]", ("literal", "a|b", 'c"d', -2, False, None)), ("Unknown[int]", "none"), ("None", "none"),
    ("list[dict[str, list[tuple[int, Optional[float]]]]]", ("list", ("dict", "str", ("list", ("tuple", "int", ("union", "float", "none")))))),
    ("typing.List[typing.Optional[int]]", ("list", ("union", "int", "none"))),
])
def test_values_of_nested_types(spark, declared, tree):
    params = spark.createDataFrame([(f"f{k}", 0, "x", declared, False, None) for k in range(8)],
                                   "func STRING, ord INT, param STRING, type STRING, optional BOOLEAN, default STRING")
    got = [json.loads(r["args"])[0] for r in inputs.edge_cases(params, 12).collect()]
    assert all(fits(tree, v) for v in got), [v for v in got if not fits(tree, v)][:3]
    assert len({json.dumps(v) for v in got}) > 1 or tree in ("none", ("tuple",))


def test_error_class(spark):
    assert one(spark, compare.error_class(F.lit("ValueError: a: b"))) == "ValueError"
    assert one(spark, compare.error_class(F.lit(None).cast("string"))) == ""


def test_waits(spark):
    logs = ["HTTP 429", "Quota exceeded", "429 {'retryDelay': '56s'}"]
    data = [(1, i, m) for i, m in enumerate(logs)] + [(2, 0, "503"), (2, 1, "bad key"), (2, 2, "503")]
    data += [(3, i, "429") for i in range(12)]
    got = {r["request_id"]: r for r in replies.retry_waits(spark.createDataFrame(data, "request_id INT, ts INT, message STRING")).collect()}
    assert (got[1]["waits"], got[1]["outcome"]) == ([5, 25, 58], "waiting")
    assert (got[2]["waits"], got[2]["outcome"]) == ([5], "fatal")
    assert len(got[3]["waits"]) == 10 and got[3]["outcome"] == "exhausted"


@pytest.mark.parametrize("known, filled", [
    ({1: 0, 5: 100}, [25, 50, 75]), ({1: 0, 2: 60, 5: 100}, [60, 60, 75]), ({1: 0, 3: 10, 5: 100}, [25, 10, 75]),
])
def test_backfill(spark, known, filled):
    wide = spark.range(1).select(F.lit(1).alias("job_id"), *[
        F.lit(known[n] * 1_000_000 if n in known else None).cast("long").alias(f"t{n}") for n in range(1, 6)])
    row = jobs.backfill(wide).head()
    assert [row[f"t{n}"] // 1_000_000 for n in (2, 3, 4)] == filled


@pytest.mark.parametrize("line, stage, label", [
    ("::STAGE::1::cAST\n", 1.0, "cAST"), ("noise ::STAGE::3.5", 3.5, "llm_agent"), ("::STAGE::9", 9.0, "running"),
    ("::STAGE::x", None, None), ("::STAGE::1d", None, None), ("a::b::STAGE::2", None, None), ("plain", None, None),
])
def test_markers(spark, line, stage, label):
    df = spark.createDataFrame([(1, 0, line)], "job_id INT, ts INT, line STRING")
    got = [(r["stage"], r["stage_label"]) for r in jobs.parse_markers(df).collect()]
    assert got == ([] if stage is None else [(stage, label)])


@pytest.mark.parametrize("path, ext", [
    ("a/b.PY", ".py"), ("b.tar.gz", ".gz"), ("a.b/c", ""), (".bashrc", ""), ("x/.hidden.py", ".py"), ("noext", ""),
])
def test_extension(spark, path, ext):
    assert one(spark, languages.extension(F.lit(path))) == ext


@pytest.mark.parametrize("n, shown", [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (1048576, "1.00 MB")])
def test_size(spark, n, shown):
    assert one(spark, text.human_size(F.lit(n))) == shown


@pytest.mark.parametrize("rate, even, half_up", [(0.125, "12%", "13%"), (0.5, "50%", "50%"), (1.0, "100%", "100%"), (0.285, "28%", "28%")])
def test_percent(spark, rate, even, half_up):
    assert one(spark, text.percent(F.lit(rate))) == even
    assert one(spark, text.percent(F.lit(rate), half_up=True)) == half_up
    assert one(spark, text.percent(F.lit(None).cast("double"))) == "—"


@pytest.mark.parametrize("outcome, severity, first, failed", [
    ((True, True, True), "pass", None, ""), ((True, True, False), "warning", "[linting] m2", "linting"),
    ((False, False, True), "error", "[syntax] m0", "syntax"),
])
def test_roll_up(spark, outcome, severity, first, failed):
    names = ["syntax", "ast_structure", "linting"]
    data = [("f", 1, i, n, ok, f"m{i}") for i, (n, ok) in enumerate(zip(names, outcome))]
    df = spark.createDataFrame(data, "file STRING, attempt INT, ord INT, check STRING, ok BOOLEAN, message STRING")
    row = rollup.roll_up(df).head()
    assert (row["severity"], row["first_failure"], row["failed_checks"]) == (severity, first, failed)


@pytest.mark.parametrize("mode, expected", [
    ("reference", "class A:\n    def m(self):\n        return 2\nend\n"), ("shift", "class A:\n    def m(self):\n            return 2\nend\n"),
])
def test_indent(spark, mode, expected):
    files = spark.createDataFrame([("f", "class A:\n    def m(self):\n        return 1\nend\n")], "file STRING, content STRING")
    patch = spark.createDataFrame([("f", 2, 3, "def m(self):\n        return 2")], "file STRING, start_line INT, end_line INT, code STRING")
    assert replies.splice(files, patch, indent=mode)[0].head()["content"] == expected


@pytest.mark.parametrize("content", ["a\nb\nc\n", "a\nb\nc", "a\r\nb\r\nc\r\n", "a\rb\rc", "  a\n\tb\n\n c"])
def test_round_trip_keeps_bytes(spark, content):
    files = spark.createDataFrame([("f", content)], "file STRING, content STRING")
    lines = content.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    patches = spark.createDataFrame(
        [("f", 1, 1, lines[0]), ("f", 2, 3, "\n".join(lines[1:3]))], "file STRING, start_line INT, end_line INT, code STRING")
    out, bad = replies.splice(files, patches, newline="preserve")
    assert out.head()["content"] == content and bad.isEmpty()


def test_output_name(spark):
    assert one(spark, replies.output_name(F.lit("a.b/c.x.py"))) == "a.b/c.x.refactored.py"
