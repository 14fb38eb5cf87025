"""Queries over sources: scan, decoding, archives, generated inputs."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from patchloom import config
from patchloom.operators import inputs, replies
from patchloom.plans.derive import _pick
from patchloom.plans.registry import query, read
from patchloom.session import work_path
from patchloom.sources import corpus, documents, envelopes


@query("corpus_scan", """
SELECT 'k=' || doc_id % 50 AS folder, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes,
  CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines, CAST(sum(length(text) + 1) AS BIGINT) AS chars
FROM documents GROUP BY 1""")
def corpus_scan(spark, sf_dir):
    """Documents written as text files, found again in their folders, decoded and counted."""
    path = work_path(spark, "corpus")
    docs = read(spark, sf_dir, "documents").filter("text IS NOT NULL")
    docs.select((F.col("doc_id") % 50).alias("k"), "text").write.partitionBy("k").text(path)
    found = corpus.scan_files(spark, path, glob="*.txt", recursive=True).withColumn("content", corpus.decode(F.col("content")))
    return found.groupBy(F.regexp_extract("file", r"([^/]*)/[^/]*\z", 1).alias("folder")).agg(
        F.sum("length").alias("bytes"), F.sum(F.size(F.split("content", "\n")) - 1).alias("lines"),
        F.sum(F.char_length("content")).alias("chars"))


@query("decode_text", "SELECT doc_id, text AS content, len(string_split(text, chr(10))) AS n_lines FROM documents")
def decode_text(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    narrow = (F.col("doc_id") % 10 == 0) & ~F.col("text").rlike(r"[^\x00-\xff]")
    raw = F.when(narrow, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    decoded = docs.select("doc_id", raw.alias("raw")).select("doc_id", corpus.decode(F.col("raw")).alias("content"))
    return corpus.with_lines(decoded).select("doc_id", "content", F.size("lines").cast("long").alias("n_lines"))


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file, content`` from ``file, doc_id, text``, a few megabytes of texts at a time."""
    def build(i: int, body: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(f"pkg/d{i}.py", body)
            z.writestr("pkg/__pycache__/d.py", body)
            z.writestr("../evil.py", body)
            z.writestr("__main__.py", body)
            z.writestr("readme.txt", body)
        data = out.getvalue()
        return data[: len(data) // 2] if i is not None and i % 11 == 0 else data
    for batch in (part for b in batches for part in corpus.portions(b, "text")):
        made = [build(i, t) for i, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["file", "content"])


@query("zip_members", """
WITH m AS (
  SELECT doc_id, text, unnest(['pkg/d' || doc_id || '.py', 'pkg/__pycache__/d.py', '../evil.py', '__main__.py', 'readme.txt']) AS member FROM documents WHERE doc_id % 11 <> 0)
SELECT 'a' || doc_id || '.zip' AS archive, member, member LIKE 'pkg/d%' AS kept, length(text) AS chars, false AS broken FROM m
UNION ALL SELECT 'a' || doc_id || '.zip', NULL, false, NULL, true FROM documents WHERE doc_id % 11 = 0""")
def zip_members(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id")
    archives = docs.select(
        F.concat(F.lit("a"), F.col("doc_id").cast("string"), F.lit(".zip")).alias("file"), "doc_id", "text").mapInArrow(
        _archives, "file string, content binary")
    found = corpus.expand_archives(archives)
    return found.select(
        "archive", "member", F.coalesce("kept", F.lit(False)).alias("kept"),
        F.length(corpus.decode(F.col("content"))).cast("long").alias("chars"), F.col("error").isNotNull().alias("broken"))


@query("output_names", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a.b/d' || doc_id || '.refactored' ELSE 'src/d' || doc_id || '.x.refactored.py' END AS output FROM documents""")
def output_names(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a.b/d"), n)).otherwise(F.concat(F.lit("src/d"), n, F.lit(".x.py")))
    return read(spark, sf_dir, "documents").select("doc_id", replies.output_name(path).alias("output"))


TYPES = ["int", "float", "str", "bool", "list", "dict", "tuple", "set", "list[int]", "union[int,str]", "literal[a,b,c]", "dict[str,int]", "any",
         "List[list[int]]", "tuple[int, ...]", "dict[int, list[str]]", "Optional[Tuple[int, str]]", "set[int | str]", "int | None",
         "dict[str, dict[int, tuple[float, ...]]]", "Literal['a,b', 3, True]", "SomeClass"]
# The same types as trees, for the SQL.
TREES = {
    "List[list[int]]": ("list", ("list", "int")), "tuple[int, ...]": ("some", "int"), "dict[int, list[str]]": ("dict", "int", ("list", "str")),
    "Optional[Tuple[int, str]]": ("union", True, ("tuple", "int", "str")), "set[int | str]": ("set", ("union", False, "int", "str")),
    "int | None": ("union", True, "int"), "dict[str, dict[int, tuple[float, ...]]]": ("dict", "str", ("dict", "int", ("some", "float"))),
    "Literal['a,b', 3, True]": ("literal", '"a,b"', "3", "true"), "SomeClass": ("literal", "null"),
}


def _signatures(spark, sf_dir):
    """Two parameters per part: types by key, a default on some, optional on others."""
    part = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    param = lambda n, name, kind, optional, default: F.struct(
        F.lit(n).alias("ord"), F.lit(name).alias("param"), kind.alias("type"), optional.alias("optional"), default.alias("default"))
    none = F.lit(None).cast("string")
    return part.select(
        F.concat(F.lit("f"), k.cast("string")).alias("func"),
        F.inline(F.array(
            param(0, "self", F.lit("any"), F.lit(False), none),
            param(1, "a", _pick(k % len(TYPES), TYPES), k % 2 == 0, none),
            param(2, "b", F.lit("int"), F.lit(False), F.when(k % 3 == 0, F.lit("42"))),
            param(3, "*rest", F.lit("any"), F.lit(False), none),
        )))


def _sql_edges(kind: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in config.EDGE_VALUES[kind]) + "]"


ROLL = "CAST('0x' || md5({parts})[1:8] AS BIGINT)"


def _pool(kind: str, roll: str) -> str:
    extra = {
        "int": f"'' || ({roll} % 2001 - 1000)", "float": f"({roll} % 2001 - 1000) || '.5'", "str": f"'\"s' || {roll} || '\"'",
        "list": f"'[' || {roll} % 101 || ']'", "dict": f"'{{\"k' || {roll} % 10000 || '\": ' || {roll} % 10 || '}}'", "tuple": f"'[' || {roll} % 5 || ']'",
    }
    edges = _sql_edges(kind)
    return f"list_append({edges}, {extra[kind]})" if kind in extra else edges


def _choice(kind: str, roll: str) -> str:
    pool = _pool(kind, roll)
    return f"({pool})[1 + {roll} % len({pool})]"


def _tree_sql(tree, seed: str, first: str, level: int = 0) -> str:
    roll, j = ROLL.format(parts=seed), f"j{level}"
    if isinstance(tree, str):
        return f"CASE WHEN {first} THEN ({_sql_edges(tree)})[1] ELSE {_choice(tree, roll)} END"
    kind, *parts = tree
    inner = lambda t, mark, at, start="false": _tree_sql(t, f"{seed} || '|{mark}|' || {at}", start, level + 1)
    count = lambda most: f"generate_series(1, CASE WHEN {first} THEN 0 ELSE {roll} % {most} END)"
    if kind in ("list", "some", "set"):
        found = f"list_transform({count(4 if kind == 'set' else 5)}, lambda {j}: {inner(parts[0], 'item', j)})"
        if kind == "set":
            found = f"list_filter({found}, lambda x{level}, i{level}: list_position({found}, x{level}) = i{level})"
        return f"'[' || array_to_string({found}, ', ') || ']'"
    if kind == "tuple":
        return "'[' || " + " || ', ' || ".join(inner(t, "item", k, first) for k, t in enumerate(parts)) + " || ']'"
    if kind == "union":
        none, *some = parts
        chosen = " ".join(f"WHEN {k} THEN {inner(t, 'item', 0, first)}" for k, t in enumerate(some))
        value = f"CASE CASE WHEN {first} THEN 0 ELSE {roll} % {len(some)} END {chosen} END"
        gone = ROLL.format(parts=f"{seed} || '|none'")
        return f"CASE WHEN NOT {first} AND {gone} % 100 < 15 THEN 'null' ELSE {value} END" if none else value
    if kind == "dict":
        key = f"'\"k' || {j} || '\"'" if parts[0] == "str" else f"'\"' || {inner(parts[0], 'key', j)} || '\"'"
        keys = f"list_transform({count(4)}, lambda {j}: {key})"
        pairs = f"list_transform({count(4)}, lambda {j}: CASE WHEN list_position({keys}, {key}) = {j} THEN {key} || ': ' || {inner(parts[1], 'item', j)} END)"
        return f"'{{' || array_to_string(list_filter({pairs}, lambda p{level}: p{level} IS NOT NULL), ', ') || '}}'"
    return f"[{', '.join(_quoted(p) for p in parts)}][CASE WHEN {first} THEN 1 ELSE 1 + {roll} % {len(parts)} END]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _value_sql() -> str:
    seed = "func || '|a|' || c"
    roll = ROLL.format(parts=seed)
    item = lambda j: ROLL.format(parts=f"{seed} || '|item|' || {j}")
    whens = []
    for i, kind in enumerate(TYPES):
        if kind in TREES:
            value = _tree_sql(TREES[kind], seed, "(c = 0)")
        elif kind == "list[int]":
            value = f"CASE WHEN c = 0 THEN '[]' ELSE '[' || array_to_string(list_transform(generate_series(1, {roll} % 5), lambda j: {_choice('int', item('j'))}), ', ') || ']' END"
        elif kind == "dict[str,int]":
            value = f"CASE WHEN c = 0 THEN '{{}}' ELSE '{{' || array_to_string(list_transform(generate_series(1, {roll} % 4), lambda j: '\"k' || j || '\": ' || {_choice('int', item('j'))}), ', ') || '}}' END"
        elif kind == "union[int,str]":
            value = f"CASE WHEN c = 0 THEN '0' WHEN {roll} % 2 = 0 THEN {_choice('int', item(0))} ELSE {_choice('str', item(0))} END"
        elif kind == "literal[a,b,c]":
            value = f"'\"' || ['a', 'b', 'c'][CASE WHEN c = 0 THEN 1 ELSE 1 + {roll} % 3 END] || '\"'"
        else:
            value = f"CASE WHEN c = 0 THEN ({_sql_edges(kind)})[1] ELSE {_choice(kind, roll)} END"
        whens.append(f"WHEN {i} THEN {value}")
    return f"CASE k % {len(TYPES)} {' '.join(whens)} END"


@query("edge_case_rows", f"""
WITH p AS (SELECT p_partkey AS k, 'f' || p_partkey AS func, unnest([0, 1, 2, 3, 4, 5]) AS c FROM part),
v AS (
  SELECT func, c,
    CASE WHEN c > 0 AND k % 2 = 0 AND {ROLL.format(parts="func || '|a|' || c || '|none'")} % 100 < 15 THEN 'null' ELSE {_value_sql()} END AS a,
    CASE WHEN c > 0 AND k % 3 = 0 AND {ROLL.format(parts="func || '|b|' || c || '|default'")} % 100 < 20 THEN '42'
         WHEN c = 0 THEN '0' ELSE {_choice('int', ROLL.format(parts="func || '|b|' || c"))} END AS b
  FROM p)
SELECT func, CAST(c AS INT) AS case_no, '[' || a || ', ' || b || ']' AS args FROM v""")
def edge_case_rows(spark, sf_dir):
    return inputs.edge_cases(_signatures(spark, sf_dir))


@query("document_files", """
WITH d AS (SELECT 'p/d' || doc_id AS stem, doc_id, n_chars, coalesce(text, '') AS text FROM documents)
SELECT stem || '.refactored.py' AS path, CAST(strlen('# ' || doc_id || chr(10) || text) AS BIGINT) AS bytes, sha256('# ' || doc_id || chr(10) || text) AS sha256 FROM d
UNION ALL
SELECT path, CAST(strlen(t) AS BIGINT), sha256(t) FROM (
  SELECT stem || '_validation_report' || CASE WHEN part > 0 THEN '.' || part ELSE '' END || '.json' AS path,
    '{"file":"' || stem || '.py","part":' || part || ',"chars":' || n_chars || '}' AS t
  FROM d, (SELECT unnest([0, 1]) AS part) WHERE part = 0 OR doc_id % 10 = 0)""")
def document_files(spark, sf_dir):
    """Rewritten files and reports written one file each, the second time over the first, and read back."""
    docs = read(spark, sf_dir, "documents", "doc_id")
    name = F.concat(F.lit("p/d"), F.col("doc_id").cast("string"), F.lit(".py"))
    text = F.concat(F.lit("# "), F.col("doc_id").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")))
    reports = docs.select(name.alias("file"), "n_chars", F.explode(
        F.when(F.col("doc_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("part"))
    reports = reports.select("file", "part", F.to_json(F.struct("file", "part", F.col("n_chars").alias("chars"))).alias("report"))
    root = work_path(spark, "documents")
    documents.write_documents(documents.outputs(docs.filter("doc_id % 2 = 0").select(name.alias("file"), F.lit("earlier").alias("content"))), root)
    written = documents.write_documents(documents.outputs(docs.select(name.alias("file"), text.alias("content")), reports), root)
    back = documents.read_documents(written, root)
    return back.select("path", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))


@query("example_source", """
WITH d AS (SELECT doc_id, lang, doc_id // 10 AS k, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) - 1 AS position FROM documents)
SELECT 'e' || doc_id AS id, coalesce(lang, '*') AS language, 'function' AS chunk_type, CAST(position AS INT) AS position
FROM d WHERE k % 7 <> 3""")
def example_source(spark, sf_dir):
    """Example files of ten entries each, of which some are no JSON; a folder that is not there gives none."""
    docs = read(spark, sf_dir, "documents", "doc_id")
    entry = F.struct(
        F.col("doc_id").alias("_at"), F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("id"), F.coalesce("lang", F.lit("*")).alias("language"),
        F.lit("function").alias("chunk_type"), F.lit("d").alias("description"), F.lit("b").alias("before"), F.lit("a").alias("after"), F.lit("").alias("notes"))
    packed = docs.groupBy(F.floor(F.col("doc_id") / 10).alias("k")).agg(F.sort_array(F.collect_list(entry)).alias("examples"))
    whole = F.to_json(F.struct(F.transform("examples", lambda e: e.dropFields("_at")).alias("examples")))
    text = F.when(F.col("k") % 7 == 3, F.concat(F.lit("{oops"), whole)).otherwise(whole)
    root = work_path(spark, "examples")
    documents.write_documents(packed.select(F.concat(F.lit("x"), F.col("k").cast("string"), F.lit(".json")).alias("path"), text.alias("text")), root)
    found = envelopes.read_examples(spark, root).unionByName(envelopes.read_examples(spark, root + "-none"))
    return found.select("id", "language", "chunk_type", "position")
