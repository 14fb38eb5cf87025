"""Unit extraction on hand-written files in several languages."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.operators import brace, lexing, python_units

PYTHON = '''import x


@decorated
class Item:
    a: int = 0


class Service(Base, Other):
    """doc"""

    def __init__(self, repo):
        self.repo = repo

    async def load(self, key, *, deep=False):
        def inner():
            return key
        return inner()

    @staticmethod
    def show(value):
        class Nested:
            def m(self): pass
        return value


def check(items, /, limit=3, *rest, **extra) -> bool:
    def helper():
        return 1
    return True


async def fetch(url):
    return url


def _private(): pass
'''

JS = """import a from 'b';
class Item {
  constructor(a) { this.a = a; }
  total() { return `${this.a}}`; }
}

export const add = (a, b) => {
  return { sum: a + b }; // }
};
if (x) {
  run();
}
/* { */
export default async function main(args) {
  const s = "}\\"}";
  return s;
}
function broken() {
"""

GO = """package p

type Status struct {
	Code int
}

type Runner interface {
	Run() error
}

func New() *Status { return &Status{} }

func (s *Status) Run(ctx Context) error {
	for i := 0; i < 3; i++ {
	}
	return nil
}
"""

JAVA = """public class Job {
    public Job(int n) { }
    private static final List<String> names(int k) {
        return null;
    }
}
interface Sink { void put(); }
enum Level { LOW, HIGH }
"""

CPP = """namespace app {
struct Inner { int a; };
}
class Box {
  int v;
};
static int add(int a, int b) {
  if (a) { return b; }
  return a + b;
}
"""

RUST = """pub struct P { x: i32 }
pub struct Unit;
impl P {
    fn new<'a>(c: &'a str) -> P { let q = '{'; P { x: 1 } }
}
trait T { fn f(&self); }
pub enum E { A, B }
pub async fn go() { }
"""

PHP = """<?php
# } comment
final class A {
  public function m() { return "}"; }
}
interface I { }
trait X { }
function f() { }
"""


def units(spark, language, content, **options):
    df = spark.createDataFrame([("f", language, content)], "file STRING, language STRING, content STRING")
    got = brace.brace_units(df, **options).collect()
    return sorted((r["start_line"], r["end_line"], r["type"], r["name"]) for r in got)


@pytest.mark.parametrize("language, content, expected", [
    ("javascript", JS, [(2, 5, "class", "Item"), (7, 9, "function", "add"), (14, 17, "function", "main")]),
    ("go", GO, [(3, 5, "struct", "Status"), (7, 9, "interface", "Runner"), (11, 11, "function", "New"), (13, 17, "function", "Run")]),
    ("java", JAVA, [(1, 6, "class", "Job"), (7, 7, "interface", "Sink"), (8, 8, "enum", "Level")]),
    ("cpp", CPP, [(1, 3, "namespace", "app"), (4, 6, "class", "Box"), (7, 10, "function", "add")]),
    ("rust", RUST, [(1, 1, "struct", "P"), (3, 5, "impl", "P"), (6, 6, "trait", "T"), (7, 7, "enum", "E"), (8, 8, "function", "go")]),
    ("php", PHP, [(3, 5, "class", "A"), (6, 6, "interface", "I"), (7, 7, "trait", "X"), (8, 8, "function", "f")]),
])
def test_brace_units(spark, language, content, expected):
    assert units(spark, language, content) == expected


def test_nested_and_control_words(spark):
    inside = units(spark, "java", JAVA, nested=True)
    assert (2, 2, "constructor", "Job") in inside and (3, 5, "method", "names") in inside
    assert (10, 12, "method", "if") in units(spark, "javascript", JS, keep_control_words=True)


def test_long_literal_survives(spark):
    content = 'function a() {\n  s = "' + "\\\"" * 50_000 + '";\n}\n/*' + "*" * 50_000 + "*/\nfunction b() {\n}\n"
    assert units(spark, "javascript", content) == [(1, 3, "function", "a"), (5, 6, "function", "b")]


def test_open_literal_is_flagged(spark):
    data = [("ok", "go", 'x := "a"\n'), ("open", "go", 'x := "a\n}'), ("block", "go", "/* a"), ("none", "go", "a")]
    df = spark.createDataFrame(data, "file STRING, language STRING, content STRING")
    assert {r["file"]: r["open_literal"] for r in brace.open_literals(df).collect()} == {
        "ok": False, "open": True, "block": True, "none": False}


# Texts whose literals and comments hold block marks; the steps are what is left outside them.
LITERALS = [
    ("javascript", 'a = `x ${ {b: `}${1}`} } }`; if (/[{"]/.test(s)) { x = a / b; "}" } // {\n', [1, -1, 1, -1], False),
    ("javascript", "x = y / 2; z = '}' / 3\nreturn /}/g\n", [], False),
    ("typescript", "`open ${ {} } {\n", [1, -1], True),
    ("javascript", 's = "open {\nfunction f() {\n}\n', [1, -1], True),
    ("java", 'String s = """\n } " { \\""" x\n"""; char c = \'"\'; {}', [1, -1], False),
    ("c", "int n = 1'000'000; char c = '{'; char d = '\\''; { /* } */ }", [1, -1], False),
    ("cpp", 'auto s = R"x( } )" { )x"; auto t = u8R"(")"; { }', [1, -1], False),
    ("cpp", "#error don't {\n{}", [1, -1], True),
    ("go", "x := `{\"` + \"}\"; r := '{'\nfunc f() {}", [1, -1], False),
    ("rust", "fn f<'a>(x: &'a str) { let s = r##\"\"} \"# {\"##; let c = '}'; /* a /* { */ } */ let q = '\\u{1F600}'; }", [1, -1], False),
    ("rust", "/* /* */ {", [], True),
    ("php", "<b>{</b><?php # } x ?>{<?php function f() { $x = <<<EOT\n } {$a}\n  EOT; return \"}{$x}\"; } #[A]\n{}", [1, -1, 1, -1], False),
    ("php", "$s = <<<'X'\n{\nX;\nfunction f() { }", [1, -1], False),
    ("php", "$s = <<<X\n{\n", [], True),
    ("ruby", "class A\n  s = \"a #{x.map do |y| \"}#{y}\" end} end\"\n  return 1 if x\nend\n", [1, 1, -1, -1], False),
    ("ruby", "y = <<~EOS.strip + <<~TWO\n  end class\nEOS\n  def\nTWO\nwhile x do\n  z = %w(end (def) class)\nend\n", [1, -1], False),
    ("ruby", "def n = 1\ndef m(a)\n  v = if a then 1 else 2 end\n  /end/ =~ v\n  a.end; {end: 1}\nend\n__END__\nclass\n", [1, -1, 1, 1, -1, -1], False),
    ("ruby", "x <<FOO\n=begin\nend\n=end\nmodule M; end\n", [1, -1], False),
]


@pytest.mark.parametrize("language, text, steps, never", LITERALS)
def test_marks_outside_literals(language, text, steps, never):
    found = lexing.lex(language, text)
    assert (found.step.tolist(), found.open) == (steps, never)


@pytest.mark.parametrize("language", lexing.LANGUAGES)
def test_lexers_take_any_text(language):
    rng = random.Random(language)
    parts = ["{", "}", '"', "'", "`", "${", "#{", "/*", "*/", "//", "\n", "\\", "<<<EOT\n", "<<~EOT", "EOT", 'R"x(', ')x"', "r#\"", "\"#", "#", "/",
             "a", "end", "def f", "class A", " ", "%w(", ")", "<?php", "?>", "if", "é\U0001F600"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        found = lexing.lex(language, text)
        assert len(found.at) == len(found.step) and (np.diff(found.at) > 0).all()
        assert all(0 <= a <= b <= len(text) for a, b in found.spans.tolist())
        n = text.count("\n") + 1
        for end, inside, _ in lexing.bodies(language, text, list(range(1, n + 1))):
            assert end is None and not inside or 1 <= end <= n


RUBY = """# class No
module Shop
  class Item < Base
    attr_reader :name
    def initialize(name)
      @name = name unless name.nil?
    end
    def ==(other) = other.name == name
    def self.load(rows)
      rows.each do |r|
        puts "end #{r}" if r
      end
    end
  end
end
def price=(v)
  @v = case v when 1 then 2 end
end
"""


def test_ruby_units(spark):
    assert units(spark, "ruby", RUBY) == [(2, 15, "module", "Shop"), (16, 18, "method", "price=")]
    inside = units(spark, "ruby", RUBY, nested=True)
    assert {(3, 14, "class", "Item"), (5, 7, "method", "initialize"), (9, 13, "method", "load")} <= set(inside)


def test_lines_in_comments_start_no_unit(spark):
    content = "/*\nfunction a() {\n}\n*/\nconst s = `\nclass B {\n}\n`\nfunction c() {\n}\n"
    assert units(spark, "javascript", content) == [(9, 10, "function", "c")]
    assert len(units(spark, "javascript", content, keep_masked=True)) == 3


def test_a_file_of_many_braces(spark):
    n = 100_000
    content = "function a() {\n" * n + "}\n" * n
    assert units(spark, "javascript", content) == [(1, 2 * n, "function", "a")]
    df = spark.createDataFrame([("f", "go", content), ("g", "xyz", content), ("h", "go", None)], "file STRING, language STRING, content STRING")
    got = {r["file"]: (r["opens"], r["closes"], r["unclosed"]) for r in brace.block_balance(df).collect()}
    assert got == {"f": (n, n, 0), "g": (None, None, None), "h": (0, 0, 0)}


def test_units_need_no_shuffle(spark):
    df = spark.createDataFrame([("f", "go", "x")], "file STRING, language STRING, content STRING")
    plan = brace.brace_units(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def naive_pairs(steps):
    """Stack matching, to compare the level form with."""
    stack, found = [], {}
    for k, step in enumerate(steps):
        if step == 1:
            stack.append(k)
        elif stack:
            found[stack.pop()] = k
    return found


@pytest.mark.parametrize("seed", range(20))
def test_partners_equal_a_stack(seed):
    rng = random.Random(seed)
    steps = [rng.choice([1, 1, -1, -1] if seed % 2 else [1, 1, -1]) for _ in range(rng.randint(0, 80))]
    depth, kept = 0, []
    for step in steps:
        if depth + step >= 0:
            depth += step
            kept.append(step)
    got = lexing.partners(np.array(kept, np.int64))
    assert {k: int(p) for k, p in enumerate(got) if p >= 0} == naive_pairs(kept)


def parsed(spark, content):
    return python_units.parse(spark.createDataFrame([("f.py", content)], "file STRING, content STRING"))


def test_python_units(spark):
    got = sorted(
        (r["start_line"], r["end_line"], r["type"], r["name"], r["parent"]) for r in python_units.units(parsed(spark, PYTHON)).collect())
    assert got == [
        (4, 6, "class", "Item", None), (9, 24, "class", "Service", None), (12, 13, "method", "__init__", "Service"),
        (15, 18, "async_method", "load", "Service"), (20, 24, "method", "show", "Service"), (22, 23, "class", "Nested", None),
        (23, 23, "method", "m", "Nested"), (27, 30, "function", "check", None), (28, 29, "function", "helper", None),
        (33, 34, "async_function", "fetch", None), (37, 37, "function", "_private", None),
    ]


def test_fingerprints(spark, rows):
    top = python_units.top_level(python_units.units(parsed(spark, PYTHON)))
    by_name = {r["name"]: r for r in top.collect()}
    assert set(by_name) == {"Item", "Service", "check", "fetch", "_private"}
    check = by_name["check"]
    assert (check["positional_args"], check["has_varargs"], check["has_kwargs"], check["has_return_ann"]) == (2, True, True, True)
    assert (by_name["Service"]["method_count"], by_name["Service"]["base_count"]) == (3, 2)
    public = python_units.public_functions(python_units.units(parsed(spark, PYTHON)))
    assert rows(public, "name") == [("check",), ("fetch",)]


@pytest.mark.parametrize("content, start", [
    ("def f(:\n", "SyntaxError at line 1"), ("return 1\n", "Compile error:"), ("a = 1\0", "SyntaxError"),
    ("(" * 5000, "SyntaxError"), ("x = 1\n", "Syntax OK"), ("", "Syntax OK"),
])
def test_syntax_status(spark, content, start):
    row = python_units.syntax_status(parsed(spark, content)).head()
    assert row["message"].startswith(start) or row["message"].startswith("AST parse failed")
    assert row["ok"] is (start == "Syntax OK")


def test_last_definition_wins(spark):
    top = python_units.top_level(python_units.units(parsed(spark, "def f(a): pass\ndef g(): pass\ndef f(a, b): pass\n")))
    assert sorted((r["name"], r["ord"], r["positional_args"]) for r in top.collect()) == [("f", 1, 2), ("g", 2, 0)]


def test_continued_lines_equal_the_tokenizer():
    """Lines that go on with a statement, in this repository's own files."""
    import io
    import tokenize
    from pathlib import Path

    for path in sorted(Path(__file__).parent.parent.glob("**/*.py")):
        text = path.read_text()
        begun, fresh, on = True, True, set()
        for token in tokenize.generate_tokens(io.StringIO(text).readline):
            if token.type in (tokenize.NEWLINE, tokenize.ENDMARKER) or token.type == tokenize.NL and fresh:
                fresh = True
                continue
            if token.type in (tokenize.INDENT, tokenize.DEDENT):
                continue
            if token.type == tokenize.COMMENT and fresh:
                continue  # a line of its own
            first = token.start[0] if fresh else begun
            on |= set(range(first + 1, token.end[0] + (token.type != tokenize.NL)))
            begun, fresh = first, False
        got = {k + 1 for k, x in enumerate(lexing.continued_lines("python", text)) if x}
        assert got - {text.count("\n") + 1} == on - {text.count("\n") + 1}, (path, sorted(got ^ on)[:10])
