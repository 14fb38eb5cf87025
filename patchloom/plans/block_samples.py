"""Source files in nine languages made of samples whose units are stated by hand.

A file is a first line and three samples of its language, chosen by the document's id.
``@I`` stands for an id and ``@T`` for the lines of the document, which lie inside a
literal or a comment, each with a stray brace in front.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from patchloom.plans.registry import read


class Unit(NamedTuple):
    """Lines count from 1 within the sample; the lines of a document count as one."""

    type: str
    name: str
    first: int
    last: int
    nested: bool = False
    parent: str | None = None


SLOTS = 3
# Characters that end a literal or comment somewhere, or begin one.
UNQUOTED = "`\"'\\*/#$?<>\r"
FIRST_LINES = {"php": "<?php // {", "ruby": "# class {", "python": "# def f():"}
OTHER_FIRST = "// {"
SAMPLES: dict[str, list[tuple[str, list[Unit]]]] = {
    "javascript": [
        ("class A@I extends B {\n  m(x) {\n    return `{ ${ { a: `}${x}` }.a } {`;\n  }\n}",
         [Unit("class", "A@I", 1, 5), Unit("method", "m", 2, 4, True)]),
        ("/*\n@T\n*/\nconst f@I = (a) => {\n  if (/[{\"'`]/.test(a)) { return a / 2; }\n};", [Unit("function", "f@I", 4, 6)]),
        ("async function g@I(a) {\n  const s = `\n@T\n  ${a.map((x) => { return x; })} }`;\n}", [Unit("function", "g@I", 1, 5)]),
        ("let s@I = \"}{ // \\\" \";\nexport default function h@I() { return '}'; }\n// function no@I() {", [Unit("function", "h@I", 2, 2)]),
    ],
    "typescript": [
        ("export interface I@I {\n  a: string;\n  m(x: number): void;\n}", [Unit("interface", "I@I", 1, 4)]),
        ("type T@I = {\n  a: { b: \"}\" };\n};\n/* {\n@T\n*/", [Unit("type_alias", "T@I", 1, 3)]),
        ("export abstract class C@I<T> {\n  private m(a: T): string {\n    return `\n@T\n${\"}\"}`;\n  }\n}",
         [Unit("class", "C@I", 1, 7), Unit("method", "m", 2, 6, True)]),
        ("const k@I = async (x: number) => {\n  return x / 1 > 0 ? \"{\" : '}';\n};", [Unit("function", "k@I", 1, 3)]),
    ],
    "java": [
        ("public class A@I {\n  public A@I() { }\n  public static String m(int a) {\n    return \"\"\"\n@T\n      \" {\"\"\";\n  }\n}",
         [Unit("class", "A@I", 1, 8), Unit("constructor", "A@I", 2, 2, True), Unit("method", "m", 3, 7, True)]),
        ("interface S@I {\n  char c = '{';\n}", [Unit("interface", "S@I", 1, 3)]),
        ("/** {\n@T\n */\nenum E@I { X, Y }", [Unit("enum", "E@I", 4, 4)]),
        ("final class B@I { String s = \"}\\\"{\"; }\n// class No@I {", [Unit("class", "B@I", 1, 1)]),
    ],
    "c": [
        ("struct p@I {\n  char c;\n};", [Unit("struct", "p@I", 1, 3)]),
        ("/* struct {\n@T\n*/\nstatic int f@I(int a) {\n  char q = '}', r = '\\'', t = '{';\n  if (a) { return 1; }\n  return 0;\n}",
         [Unit("function", "f@I", 4, 8)]),
        ("int g@I(void) { return '{'; }", [Unit("function", "g@I", 1, 1)]),
        ("#define S@I \"}\"\nunsigned long h@I(char *s) {\n  return s[0] == '\"' ? 1 : 2; // }\n}", [Unit("function", "h@I", 2, 4)]),
    ],
    "cpp": [
        ("namespace n@I {\nclass B@I {\n  int m@I() const { return 1'000'000; }\n};\n}",
         [Unit("namespace", "n@I", 1, 5), Unit("class", "B@I", 2, 4, True), Unit("function", "m@I", 3, 3, True)]),
        ("const char* t@I() {\n  return R\"x(\n@T\n} )\" )x\";\n}", [Unit("function", "t@I", 1, 5)]),
        ("struct q@I { char c = '}'; };", [Unit("struct", "q@I", 1, 1)]),
        ("/* class No {\n@T\n*/\nclass D@I final {\n  const char* s = u8R\"({)\";\n};", [Unit("class", "D@I", 4, 6)]),
    ],
    "go": [
        ("func (r *R) F@I(a int) string {\n\treturn `{\n@T\n` + \"}\"\n}", [Unit("function", "F@I", 1, 5)]),
        ("type S@I struct {\n\ta int // }\n}", [Unit("struct", "S@I", 1, 3)]),
        ("type R@I interface { Run() }", [Unit("interface", "R@I", 1, 1)]),
        ("/* } */\nfunc g@I[T any](a T) {\n\tc := '{'\n\t_ = c\n}", [Unit("function", "g@I", 2, 5)]),
    ],
    "rust": [
        ("pub struct P@I<'a> { x: &'a str }", [Unit("struct", "P@I", 1, 1)]),
        ("impl P@I {\n    fn new<'a>(c: &'a str) -> char {\n        let s = r##\"\n@T\n\"# } \"##;\n        '{'\n    }\n}",
         [Unit("impl", "P@I", 1, 8), Unit("function", "new", 2, 7, True)]),
        ("/* outer /* {\n@T\n*/ } */\npub async fn go@I() { }", [Unit("function", "go@I", 4, 4)]),
        ("pub enum E@I { A, B }\ntrait T@I {\n    fn f(&self) -> u8 { b'}' }\n}",
         [Unit("enum", "E@I", 1, 1), Unit("trait", "T@I", 2, 4), Unit("function", "f", 3, 3, True)]),
    ],
    "php": [
        ("final class A@I {\n  public function m() {\n    return <<<EOT\n@T\n    EOT . \"}\";\n  }\n}",
         [Unit("class", "A@I", 1, 7), Unit("method", "m", 2, 6, True)]),
        ("# } {\nfunction f@I($a) { return \"{$a}\"; }", [Unit("function", "f@I", 2, 2)]),
        ("interface I@I { }\n?>\n<p> } { it's </p>\n<?php", [Unit("interface", "I@I", 1, 1)]),
        ("trait T@I {\n  #[Attr('}')]\n  private static function k() { return '\\'}'; }\n}\n/* {\n@T\n*/",
         [Unit("trait", "T@I", 1, 4), Unit("method", "k", 3, 3, True)]),
    ],
    "ruby": [
        ("class A@I < B\n  def m(x)\n    return 1 if x\n    \"end #{x.map do |y| \"}#{y}\" end}\"\n  end\nend",
         [Unit("class", "A@I", 1, 6), Unit("method", "m", 2, 5, True)]),
        ("def t@I\n  <<~EOT.strip\n@T\n    end class\n  EOT\nend", [Unit("method", "t@I", 1, 6)]),
        ("=begin\n@T\ndef no\n=end\nmodule M@I; end", [Unit("module", "M@I", 5, 5)]),
        ("def s@I(a) = a\ndef w@I(a)\n  while a do\n    a = %w(end (def) class).size\n  end\nend",
         [Unit("method", "s@I", 1, 1), Unit("method", "w@I", 2, 6)]),
    ],
}
NAMES = list(SAMPLES)
KINDS = 4


# Python files: decorators, nested functions and classes, definitions inside strings and branches.
PYTHON = {"python": [
    ('class A@I(Base, metaclass=M):\n    x = """\n@T\ndef no():\n"""\n\n    @property\n    def p(self):\n        return 1\n\n'
     '    async def q(self, a, *, b=2):\n        def inner():\n            return a\n        return inner\n\n    class Deep:\n        def d(self): pass',
     [Unit("class", "A@I", 1, 17), Unit("method", "p", 7, 9, True, "A@I"), Unit("async_method", "q", 11, 14, True, "A@I"),
      Unit("class", "Deep", 16, 17, True), Unit("method", "d", 17, 17, True, "Deep")]),
    ("@deco\n@other(\n    1,\n)\nasync def f@I(a, /, b=1, *c, d, **e) -> None:\n    async with a as x:\n        def g@I(): yield x\n    return None",
     [Unit("async_function", "f@I", 1, 8), Unit("function", "g@I", 7, 7, True)]),
    ("if True:\n    def h@I(): pass\nelse:\n    class E@I: pass\nlam = lambda x: x", [Unit("function", "h@I", 2, 2), Unit("class", "E@I", 4, 4)]),
    ('def k@I(x):\n    return """\n@T\n""" + x\n\n\nclass _P@I(k@I, object): ...', [Unit("function", "k@I", 1, 4), Unit("class", "_P@I", 7, 7)]),
]}
KINDS = 4


def files(spark: SparkSession, sf_dir: str, samples_of: dict | None = None, path: str = "s/d") -> DataFrame:
    """``file, doc_id, language, content``: one file per document."""
    samples_of = samples_of or SAMPLES
    names, at = list(samples_of), F.col("doc_id")
    texts = F.create_map(*[F.lit(x) for i, name in enumerate(names) for k, (text, _) in enumerate(samples_of[name]) for x in (i * KINDS + k, text)])
    language = F.element_at(F.array(*[F.lit(n) for n in names]), (at % len(names) + 1).cast("int"))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.concat(F.lit("{ "), F.translate(x, UNQUOTED, "")))
    kind = lambda j: (F.floor(at / len(names)) + j * (1 + F.floor(at / (len(names) * KINDS)) % 3)) % KINDS
    chosen = [
        F.replace(F.replace(F.element_at(texts, (at % len(names) * KINDS + kind(j)).cast("int")),
                            F.lit("@I"), F.concat(at.cast("string"), F.lit(f"_{j}"))), F.lit("@T"), F.array_join(lines, "\n")) for j in range(SLOTS)]
    firsts = [F.when(language == n, F.lit(line)) for n, line in FIRST_LINES.items()]
    return read(spark, sf_dir, "documents", "doc_id").select(
        F.concat(F.lit(path), at.cast("string")).alias("file"), "doc_id", language.alias("language"),
        F.concat(F.concat_ws("\n", F.coalesce(*firsts, F.lit(OTHER_FIRST)), *chosen), F.lit("\n")).alias("content"))


def _rows(samples_of: dict) -> tuple[str, str]:
    samples, units = [], []
    for i, name in enumerate(samples_of):
        for k, (text, found) in enumerate(samples_of[name]):
            lines = text.split("\n")
            mark = lines.index("@T") + 1 if "@T" in lines else 0
            samples.append(f"({i}, {k}, {len(lines)}, {mark})")
            units += [f"({i}, {k}, '{u.type}', '{u.name}', {u.first}, {u.last}, {str(u.nested).lower()}, {_text(u.parent)})" for u in found]
    return ", ".join(samples), ", ".join(units)


def _text(value: str | None) -> str:
    return "NULL" if value is None else f"'{value}'"


def expected(samples_of: dict, path: str) -> str:
    """SQL of the units: ``file, language, type, name, start_line, end_line, nested, parent`` in ``expected``."""
    samples, units = _rows(samples_of)
    names = ", ".join(f"'{n}'" for n in samples_of)
    n = len(samples_of)
    return f"""
samples(l, k, lines, mark) AS (VALUES {samples}),
sample_units(l, k, type, name, first, last, nested, parent) AS (VALUES {units}),
docs AS (SELECT doc_id, doc_id % {n} AS l, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents),
slots AS (
  SELECT doc_id, l, n, j, (doc_id // {n} + j * (1 + (doc_id // {n * KINDS}) % 3)) % {KINDS} AS k FROM docs, (SELECT unnest([0, 1, 2]) AS j)),
placed AS (
  SELECT p.*, s.mark, 1 + coalesce(sum(s.lines + CASE WHEN s.mark > 0 THEN n - 1 ELSE 0 END) OVER (
    PARTITION BY doc_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above
  FROM slots p JOIN samples s USING (l, k)),
expected AS (
  SELECT '{path}' || doc_id AS file, [{names}][1 + l] AS language, type, replace(name, '@I', doc_id || '_' || j) AS name,
    CAST(above + first + CASE WHEN mark > 0 AND first > mark THEN n - 1 ELSE 0 END AS INT) AS start_line,
    CAST(above + last + CASE WHEN mark > 0 AND last > mark THEN n - 1 ELSE 0 END AS INT) AS end_line, nested,
    replace(parent, '@I', doc_id || '_' || j) AS parent
  FROM placed JOIN sample_units USING (l, k))"""


EXPECTED = expected(SAMPLES, "s/d")
