"""Conversations brought back to a legal order of roles, by generalised LR repair.

The grammar of role initials is ``C -> nothing | L``, ``L -> s u a | u a | L u a``. Its LR
tables drive a graph-structured stack over the rows of a conversation: every row may be
kept, given another role or deleted, and rows may be put in before it; each action has
a weight. Stacks with equal tops are merged and the one with the least
``(cost, audit)`` lives on, where the audit is the string of the actions' initials.
(One audit is a prefix of another only if that one has more insertions, hence a higher
cost, so the least stays least whatever follows.) All reductions end above the bottom, so
a top stands for its whole stack.

Rows are dealt out in ranges of conversation and turn, so a long conversation lies in
several ranges and in segments of bounded size. A segment is parsed from every top it may
be entered with; a second pass over the segments, one row each, joins them in order.
The hash of a long conversation is one running hash and so is taken in one task, row by
row of segments, without holding more than one of them; its audit is one string.

Rows are taken by turn, nulls first, ties by role and text (UTF-8). Equal rows are one row
with a number of copies. Null role and text are one space; rows with a null id are a
conversation of their own; a role without letters has an empty initial, which is legal
nowhere. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from patchloom.llm.tools import portions, stored

# Tables of the grammar: shifts, how many symbols a reduction to L pops, and where L leads.
SHIFT = {(0, "s"): 1, (1, "u"): 2, (2, "a"): 3, (0, "u"): 4, (4, "a"): 5, (6, "u"): 7, (7, "a"): 8}
POPS, GOTO, ACCEPT = {3: 3, 5: 2, 8: 3}, {0: 6}, (0, 6)
# The stack below each top that can stand between two rows.
STACKS = {0: (0,), 1: (0, 1), 2: (0, 1, 2), 4: (0, 4), 6: (0, 6), 7: (0, 6, 7)}
LEGAL = ("su", "ua", "au")
RENAMES = {"u": "user", "a": "assistant"}
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
# Rows and bytes of text of a segment.
SEGMENT_ROWS, SEGMENT_BYTES = 512, 1 << 22


class Node:
    """A top of the stack: its state, the node below it, and how it was reached."""

    __slots__ = ("state", "below", "cost", "audit")

    def __init__(self, state: int, below: "Node | None", cost: int, audit: str):
        self.state, self.below, self.cost, self.audit = state, below, cost, audit


def stack(top: int) -> Node:
    node = None
    for state in STACKS[top]:
        node = Node(state, node, 0, "")
    return node


def push(node: Node, initial: str, cost: int, letter: str) -> Node | None:
    """Shift one symbol, then reduce as long as the tables say."""
    state = SHIFT.get((node.state, initial))
    if state is None:
        return None
    cost, audit = node.cost + cost, node.audit + letter
    node = Node(state, node, cost, audit)
    while node.state in POPS:
        pops, below = POPS[node.state], node
        for _ in range(pops):
            below = below.below
        node = Node(GOTO[below.state], below, cost, audit)
    return node


def merge(level: dict[int, Node], node: Node | None) -> bool:
    if node is None:
        return False
    held = level.get(node.state)
    if held is None or (node.cost, node.audit) < (held.cost, held.audit):
        level[node.state] = node
        return True
    return False


def insert(level: dict[int, Node]) -> dict[int, Node]:
    """All tops that insertions reach; each costs something, so rounds end."""
    fresh = list(level.values())
    while fresh:
        grown = [push(node, initial, INSERT, "I") for node in fresh for initial in RENAMES]
        fresh = [node for node in grown if merge(level, node)]
    return level


def step(level: dict[int, Node], initial: str, forced: bool, truncated: bool, copies: int) -> dict[int, Node]:
    """One row and its copies; a copy is always deleted, as is a forced row."""
    after: dict[int, Node] = {}
    if forced:
        gone = copies
    else:
        gone, extra = copies - 1, TRUNCATED * truncated
        for node in level.values():
            merge(after, Node(node.state, node.below, node.cost + DELETE, node.audit + "D"))
            merge(after, push(node, initial, extra, "K"))
            for other in RENAMES:
                merge(after, push(node, other, REROLE + extra, "R"))
        level = insert(after)
    if gone:
        # insertions among deletions cost the same later, and D comes before I
        level = {s: Node(n.state, n.below, n.cost + DELETE * gone, n.audit + "D" * gone) for s, n in level.items()}
        level = insert(level)
    return level


@dataclass
class Segment:
    """Consecutive rows of one conversation: ``(turn, role, text, copies, blank, repeated, truncated)``."""

    rows: list[tuple] = field(default_factory=list)

    def paths(self, tops) -> dict[int, dict[int, tuple[int, str]]]:
        """``entry -> exit -> (cost, audit)``."""
        found = {}
        for top in tops:
            level = insert({top: stack(top)})
            for _, role, _, copies, blank, repeated, truncated in self.rows:
                level = step(level, role[:1], blank or repeated, truncated, copies)
            found[top] = {s: (n.cost, n.audit) for s, n in level.items()}
        return found

    def counts(self) -> dict:
        out = {"n": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "least": None, "most": None, "first": None, "last": None}
        for turn, role, _, copies, blank, repeated, truncated in self.rows:
            initial = role[:1]
            out["n"] += copies
            if blank:
                out["blank"] += copies
            else:
                out["duplicate"] += copies - (not repeated)
                out["truncated"] += truncated and not repeated
            out["illegal"] += copies - 1 + (out["last"] is not None and out["last"] + initial not in LEGAL)
            if turn is not None:
                out["turns"] += turn != out["most"]
                out["least"], out["most"] = turn if out["least"] is None else out["least"], turn
            out["first"], out["last"] = initial if out["first"] is None else out["first"], initial
        return out

    def lines(self, top: int, audit: str) -> Iterator[tuple[str, str]]:
        """The rows that ``audit`` leaves, with their roles."""
        node, letters = stack(top), iter(audit)
        for _, role, text, copies, *_ in self.rows:
            left = copies
            while left:
                letter = next(letters)
                if letter == "I":
                    node, initial = self._next(node)
                    yield RENAMES[initial], ""
                    continue
                left -= 1
                if letter == "K":
                    node = push(node, role[:1], 0, "")
                    yield role, text
                elif letter == "R":
                    node, initial = self._next(node)
                    yield RENAMES[initial], text
        for _ in letters:
            node, initial = self._next(node)
            yield RENAMES[initial], ""

    @staticmethod
    def _next(node: Node) -> tuple[Node, str]:
        return next((after, initial) for initial in RENAMES if (after := push(node, initial, 0, "")) is not None)


class Conversation:
    """Segments joined in order: of the paths to each top the least ``(cost, audit)`` remains."""

    def __init__(self) -> None:
        # top -> cost, audit, running hash of the rows that remain, whether there are any, segments
        self.tops = {0: (0, "", hashlib.sha256(), False, ())}
        self.total = Segment().counts()

    @staticmethod
    def _hashed(digest, some: bool, lines):
        for role, text in lines:
            digest.update((("\n" if some else "") + role + ":" + text).encode())
            some = True
        return digest

    def add(self, place, segment: Segment, paths, counts) -> None:
        best: dict[int, tuple] = {}
        for entry, (cost, audit, _, _, _) in self.tops.items():
            for top, (more, letters) in paths[entry].items():
                key = (cost + more, audit + letters)
                if top not in best or key < best[top][0]:
                    best[top] = key, entry, letters
        tops = {}
        for top, ((cost, audit), entry, letters) in best.items():
            _, _, digest, some, path = self.tops[entry]
            lines = list(segment.lines(entry, letters))
            tops[top] = cost, audit, self._hashed(digest.copy(), some, lines), some or bool(lines), (path, (place, entry, letters))
        self.tops = tops
        total = self.total
        for name in ("n", "blank", "duplicate", "truncated", "illegal"):
            total[name] += counts[name]
        if counts["n"] and total["last"] is not None:
            total["illegal"] += total["last"] + counts["first"] not in LEGAL
        if counts["n"]:
            total["first"], total["last"] = counts["first"] if total["first"] is None else total["first"], counts["last"]
        if counts["least"] is not None:
            total["turns"] += counts["turns"] - (total["most"] == counts["least"])
            total["least"] = counts["least"] if total["least"] is None else total["least"]
            total["most"] = counts["most"]

    def report(self) -> dict:
        cost, audit, digest, _, path = min((self.tops[t] for t in ACCEPT if t in self.tops), key=lambda t: t[:2])
        total, steps = self.total, []
        gaps = 0 if total["least"] is None else total["most"] - total["least"] + 1 - total["turns"]
        while path:
            path, last = path
            steps.append(last)
        return {"gaps": min(gaps, (1 << 63) - 1), **{k: int(total[k]) for k in ("blank", "duplicate", "truncated", "illegal")},
                "cost": cost, "audit": audit, "repaired_sha256": digest.hexdigest(), "path": steps[::-1]}


REPORT = [("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"),
          ("audit", "string"), ("repaired_sha256", "string")]
_TURN = "turn long, role string, text string, copies long, blank boolean, repeated boolean, truncated boolean"
_NAMES = [part.split()[0] for part in _TURN.split(", ")]


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: a fault by the remainder of a row's checksum.

    Rows that are dropped stay as rows of no copies, so that their conversation is known."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    role = F.when(kind == 0, "").when(kind == 4, "user").otherwise(part("role"))
    return conversations.select(
        "conv_id", F.when(kind != 0, F.col("turn").cast("long")).alias("turn"), role.alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


def marked(rows: DataFrame) -> DataFrame:
    """Equal rows as one, with ``copies, blank, repeated, truncated``."""
    bare = F.rtrim("text", F.lit(" \t\n\x0b\f\r"))
    mark = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    spoken = rows.filter((F.col("copies") > 0) & (bare != "")).select("conv_id", "turn", mark.alias("mark"))
    # texts said at more than one turn: usually few, so the planner can choose by their size
    said = spoken.groupBy("conv_id", "mark").agg(
        F.min("turn").alias("least"), F.max("turn").alias("most"), F.max(F.col("turn").isNull()).alias("untimed"))
    said = stored(said.filter((F.col("least") != F.col("most")) | (F.col("untimed") & F.col("least").isNotNull())).select(
        F.col("conv_id").alias("said_in"), F.col("mark").alias("said"), "least", "untimed"), "said")
    single = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("mark", mark)
    joined = single.join(said, single.conv_id.eqNullSafe(said.said_in) & (single.mark == said.said), "left")
    later = F.when(F.col("untimed"), F.col("turn").isNotNull()).otherwise(F.col("turn") != F.col("least"))
    return joined.select(
        "conv_id", "turn", "role", "text", "copies", (bare == "").alias("blank"),
        ((bare != "") & F.coalesce(later, F.lit(False))).alias("repeated"),
        ((bare != "") & ~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"))


def _ordered(rows: DataFrame, *more: str) -> DataFrame:
    order = ["conv_id", "turn", "role"]
    near = [F.col(c).asc_nulls_first() for c in order]
    return rows.repartitionByRange(*near, F.substring("text", 1, 32)).sortWithinPartitions(*near, "text")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Segment, bool]]:
    """``conversation, segment, whole``: whole if no other range can hold a part of it."""
    segment, conv, size, first, begun, count = Segment(), None, 0, True, False, 0
    for batch in (part for b in batches for part in portions(b, 3)):
        for one, *row in zip(*(batch.column(k).to_pylist() for k in range(8))):
            if begun and (one != conv or (len(segment.rows) >= SEGMENT_ROWS or size >= SEGMENT_BYTES)):
                yield conv, segment, one != conv and not first and not count
                count = 0 if one != conv else count + 1
                first = first and one == conv
                segment, size = Segment(), 0
            begun, conv = True, one
            if row[3]:
                segment.rows.append(tuple(row))
                size += len(row[2])
    if begun:
        yield conv, segment, False


def parse(rows: DataFrame) -> DataFrame:
    """One row per whole conversation with its report and lines, and one per segment of the others."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    report = ", ".join(f"{n} {t}" for n, t in REPORT)
    schema = (f"conv_id {kind}, whole boolean, part int, seq int, report struct<{report}>, lines array<struct<role string, text string>>, "
              f"rows array<struct<{_TURN}>>, paths array<struct<entry int, top int, cost long, audit string>>")
    # types of an empty frame with this schema
    arrow = rows.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, held = TaskContext.get().partitionId(), [], 0
        for seq, (conv, segment, whole) in enumerate(_segments(batches)):
            row = {"conv_id": conv, "whole": whole, "part": part, "seq": seq}
            if whole:
                talk = Conversation()
                talk.add(None, segment, segment.paths(talk.tops), segment.counts())
                row["report"] = talk.report()
                path = row["report"].pop("path")
                row["lines"] = [{"role": r, "text": t} for _, entry, audit in path for r, t in segment.lines(entry, audit)]
            else:
                row["rows"] = [dict(zip(_NAMES, r)) for r in segment.rows]
                row["paths"] = [{"entry": e, "top": t, "cost": c, "audit": a} for e, to in segment.paths(STACKS).items() for t, (c, a) in to.items()]
            out.append(row)
            held += 1000 + sum(len(r[2]) for r in segment.rows)
            if held > SEGMENT_BYTES:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return _ordered(rows).mapInArrow(run, schema)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Conversation]]:
    """Conversations of segments that come in order."""
    talk, conv = None, None
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if talk is not None and row["conv_id"] != conv:
                yield conv, talk
                talk = None
            talk, conv = talk or Conversation(), row["conv_id"]
            segment = Segment([tuple(r.values()) for r in row["rows"]])
            paths: dict[int, dict[int, tuple[int, str]]] = {}
            for p in row["paths"]:
                paths.setdefault(p["entry"], {})[p["top"]] = p["cost"], p["audit"]
            talk.add((row["part"], row["seq"]), segment, paths, segment.counts())
    if talk is not None:
        yield conv, talk


def _over_segments(parsed: DataFrame, schema: str, make) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]
    kind = parsed.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {schema}"
    arrow = parsed.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, talk in _joined(batches):
            found = make(talk)
            for at in range(0, len(found), 1000):
                yield pa.RecordBatch.from_pylist([{"conv_id": conv, **dict(zip(names, f))} for f in found[at : at + 1000]], arrow)

    pieces = parsed.filter("not whole").select("conv_id", "part", "seq", "rows", "paths")
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(run, schema)


def reports(parsed: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
    names = [n for n, _ in REPORT]

    def of(talk: Conversation) -> list[tuple]:
        found = talk.report()
        return [tuple(found[n] for n in names)]

    return parsed.filter("whole").select("conv_id", "report.*").unionByName(_over_segments(parsed, ", ".join(f"{n} {t}" for n, t in REPORT), of))


def repaired_rows(parsed: DataFrame) -> DataFrame:
    """``conv_id, part, seq, nth, role, text``: the rows that remain, in order of ``part, seq, nth``."""
    def of(talk: Conversation) -> list[tuple]:
        return [(*place, entry, audit) for place, entry, audit in talk.report()["path"]]

    chosen = _over_segments(parsed, "part int, seq int, entry int, audit string", of).drop("conv_id")
    lines = "array<struct<role string, text string>>"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment([tuple(r.values()) for r in row["rows"]])
                row["lines"] = [{"role": r, "text": t} for r, t in segment.lines(row["entry"], row["audit"])]
                yield pa.RecordBatch.from_pylist([{k: row[k] for k in ("conv_id", "part", "seq", "lines")}], arrow)

    kind = parsed.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, part int, seq int, lines {lines}"
    arrow = parsed.sparkSession.createDataFrame([], schema).toArrow().schema
    cut = parsed.filter("not whole").select("conv_id", "part", "seq", "rows").join(chosen, ["part", "seq"])
    written = cut.select("conv_id", "part", "seq", "rows", "entry", "audit").mapInArrow(write, schema)
    every = parsed.filter("whole").select("conv_id", "part", "seq", "lines").unionByName(written)
    return every.select("conv_id", "part", "seq", F.posexplode("lines").alias("nth", "line")).select("conv_id", "part", "seq", "nth", "line.*")


def repair(rows: DataFrame) -> DataFrame:
    """The written result of ``parse`` for ``conv_id, turn, role, text, copies``."""
    return stored(parse(marked(rows)), "parsed")
