"""Role repair against a search over suffixes, by an automaton of its own."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest

from patchloom.llm import role_repair

BLANK, LAST = re.compile(r"[\x20\x09-\x0D]*\Z"), re.compile(r"[\x20\x09-\x0D]*\Z")
sys.setrecursionlimit(20_000)
MOVES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "p", ("p", "u"): "u"}


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        held = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for held in out.values():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def search(rows):
    """Cheapest audit and what it leaves, for ``(role, forced, truncated, text)`` rows."""
    @lru_cache(None)
    def best(k, state, put):
        found = []
        if k == len(rows) and state in ("", "p"):
            found.append((0, "", ()))
        if put < 2:
            for role in ("user", "assistant"):
                if (state, role[0]) in MOVES:
                    cost, audit, left = best(k, MOVES[state, role[0]], put + 1)
                    found.append((cost + 3, "I" + audit, ((role, ""),) + left))
        if k < len(rows):
            role, forced, truncated, text = rows[k]
            cost, audit, left = best(k + 1, state, 0)
            found.append((cost + 4, "D" + audit, left))
            for to, letter, price in ((role, "K", 0), ("user", "R", 3), ("assistant", "R", 3)):
                if not forced and (state, to[:1]) in MOVES:
                    cost, audit, left = best(k + 1, MOVES[state, to[:1]], 0)
                    found.append((cost + price + 3 * truncated, letter + audit, ((to, text),) + left))
        return min(found, default=(float("inf"), "", ()))
    return best(0, "", 0)


def brute(rows):
    out = []
    for conv, held in damaged(rows).items():
        seen, marked, counts = set(), [], [0, 0, 0]
        for _, role, text in held:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            if fault is not None:
                counts[fault] += 1
            seen.add((role, text))
            marked.append((role, fault in (0, 1), fault == 2, text))
        turns = {t for t, _, _ in held if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        cost, audit, left = search(tuple(marked))
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()))
    return sorted(out, key=repr)


def talks(seed, n=60, longest=14):
    rng = random.Random(seed)
    rows = [(500, None, "user", "Hi."), (500, None, "user", "Hi."), (501, 3, None, None), (502, -4, "", "x."), (None, None, None, None), (None, 2, "user", "a")]
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "usr", "", "Assistant"])
            text = rng.choice(["Yes.", "No!", "Well", "  ", "", "Fine? \n", "a\x0b", "zé.", "Yes."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, text))
    rows += rng.sample(rows, 30)
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], "conv_id long, turn long, role string, text string, copies int, audit string")


def run(spark, rows):
    return role_repair.repair(role_repair.damage(frame(spark, rows)))


@pytest.mark.parametrize("seed,segment", [(1, 512), (2, 1), (3, 3)])
def test_reports_equal_a_search(spark, rows, monkeypatch, seed, segment):
    monkeypatch.setattr(role_repair, "SEGMENT_ROWS", segment)
    talk = talks(seed)
    assert rows(role_repair.reports(run(spark, talk))) == brute(talk)


def test_one_long_conversation_in_segments(spark, rows):
    rng = random.Random(8)
    talk = [(7, t, rng.choice(["user", "assistant", "assistant"]), rng.choice(["Yes.", f"t{t}.", f"u{t}"])) for t in range(1500)]
    (got,) = role_repair.reports(run(spark, talk)).collect()
    held = damaged(talk)[7]
    seen, marked = set(), []
    for _, role, text in held:
        bare = text.strip()
        marked.append((role, not bare or (role, text) in seen, bool(bare) and bare[-1] not in ".!?", text))
        seen.add((role, text))
    segment = role_repair.Segment([(0, r, t, 1, False, f, tr) for r, f, tr, t in marked])
    cost, audit = min(segment.paths((0,))[0][s] for s in (0, 6) if s in segment.paths((0,))[0])
    assert (got["cost"], got["audit"]) == (cost, audit)
    # any 40 rows of it against the search
    part = marked[100:140]
    piece = role_repair.Segment([(0, r, t, 1, False, f, tr) for r, f, tr, t in part]).paths((0,))[0]
    assert min(piece[s] for s in (0, 6) if s in piece) == search(tuple(part))[:2]


def test_repaired_rows_hash_to_the_report(spark, monkeypatch):
    monkeypatch.setattr(role_repair, "SEGMENT_ROWS", 4)
    parsed = run(spark, talks(5))
    left = {}
    for r in role_repair.repaired_rows(parsed).orderBy("part", "seq", "nth").collect():
        left.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in role_repair.reports(parsed).collect():
        lines = left.get(r["conv_id"], [])
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines))


def test_many_copies_of_a_row(spark, rows):
    talk = [(3, 1, "user", "Same.")] * 700 + [(3, 2, "assistant", "Done.")]
    assert rows(role_repair.reports(run(spark, talk))) == brute(talk)


def test_empty_and_dropped(spark, rows):
    assert rows(role_repair.reports(run(spark, talks(1)).limit(0))) == []
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = rows(role_repair.reports(run(spark, [(conv, 0, "user", "Gone.")])))
    assert got == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    spark.conf.get("spark.sql.shuffle.partitions")
    assert rows(role_repair.reports(role_repair.repair(role_repair.damage(frame(spark, [(1, 1, "user", "a")]).limit(0))))) == []
