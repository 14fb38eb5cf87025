"""What a round does not do again: parse the originals, splice a file twice, or decode a line for each test of it."""

from pyspark.sql import functions as F

from patchloom.functions import text
from patchloom.operators import lint, python_units
from patchloom.plans import rounds
from patchloom.plans.prompt_queries import EXAMPLE_SCHEMA, EXAMPLES


def test_originals_are_parsed_once_and_files_spliced_once(spark, monkeypatch):
    files = spark.createDataFrame([(f"{n}.py", f"def f{n}(a):\n    return a\n") for n in range(4)], "file STRING, content STRING")
    examples = spark.createDataFrame(EXAMPLES, EXAMPLE_SCHEMA)
    parsed, plans = [], []
    parse, cut = python_units.parse, rounds.cut_lineage

    def counted(df, *args, **options):
        parsed.append(sorted(r["file"] for r in df.select("file").collect()))
        return parse(df, *args, **options)

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(python_units, "parse", counted)
    monkeypatch.setattr(rounds, "cut_lineage", seen)

    def answer(prompts, attempt):
        rows = [(r["file"], r["prompt_id"], f"```\ndef f{r['file'][0]}(a{', b' if r['file'] < '2' else ''}):\n    return a\n```")
                for r in prompts.collect() if r["file"] < "3"]
        return spark.createDataFrame(rows, "file STRING, prompt_id INT, reply STRING")

    done = rounds.run_rounds(files, examples, answer)
    every = [f"{n}.py" for n in range(4)]
    assert parsed == [every, every[:3], every[:2]]
    # the lines of a file are cut out where it is spliced
    assert {p.count(r"(?<=\n)") for p in plans} == {0, 1}
    assert {r["file"]: r["final_status"] for r in done.merged.collect()} == {
        "0.py": "FAIL", "1.py": "FAIL", "2.py": "PASS", "3.py": "SKIP"}


def test_line_tests_are_those_of_their_patterns(spark):
    parts = ["", " ", "\t", "\f", "\x0b", "\r", "\n", "x", "@", "def ", "class", "\xa0", "é", "\x1c"]
    texts = sorted({a + b + c for a in parts for b in parts for c in parts})
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t STRING")
    t = F.col("t")
    pairs = [
        (lint._blank(t), r"^[ \t\f\x0b]*\z"), (lint._trailing(t), r"[ \t\f\x0b]+\z"), (text.begins(t), r"^\S"),
        (text.starts(t, *lint.STARTS), r"^(?:def |class |async def |@)")]
    # no line holds a line feed
    lines = df.filter("t IS NULL OR NOT contains(t, '\n')")
    assert lines.filter(sum((~got.eqNullSafe(t.rlike(p))).cast("int") for got, p in pairs) > 0).collect() == []
