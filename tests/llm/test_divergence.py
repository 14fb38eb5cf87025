"""Source divergence against brute force in whole numbers."""

import random
import re
from collections import Counter

import pytest

from patchloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, least_docs, ranks):
    held, within = {}, {}
    for text, lang, source in docs:
        terms = TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        held.setdefault(lang or "", {}).setdefault(source or "", Counter()).update(terms)
        within.setdefault(lang or "", Counter()).update(set(terms))
    out = []
    for lang, groups in held.items():
        kept = sorted(t for t, n in within[lang].items() if n >= least_docs)
        v = len(kept)
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 2) // (sum(counts[k] for k in kept) + 2 * v) for t in kept}
        q = share(sum(groups.values(), Counter()))
        p = {s: share(c) for s, c in groups.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items, last in (("pair", pairs, None), ("term", terms, ranks)):
                out += [(lang, s, part, i, -value, k + 1) for k, (value, _, i) in enumerate(sorted(items)[:last])]
    return sorted(out, key=repr)


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "été", "日本", "a1b", "x-y", "\x00nul", "K", "k", "É"] + [f"w{chr(97 + k)}é" for k in range(25)] + [
        "b" * k for k in range(1, 6)] + ["\U0001F600", "z￿", "z\U00010000"]
    docs = [(None, None, None), ("", "en", "only"), ("12 34", "en", "no terms"), (None, "", "s"), ("alone alone", "xx", "s1"), (None, "xx", "s2")]
    for k in range(n):
        source = rng.choice(["hot", "hot", "s1", "s2", None, "z", "é"])
        words = [rng.choice(vocabulary[: 10 + 7 * (len(source or "") % 4)]) for _ in range(rng.randint(0, 30))]
        docs.append((rng.choice([" ", "\n", "-"]).join(words), rng.choice(["en", "en", "de", None]), source))
    return docs + docs[-5:]


def frame(spark, docs):
    return spark.createDataFrame([(k, t, la, s, "clash", 1) for k, (t, la, s) in enumerate(docs)],
                                 "doc_id long, text string, lang string, source string, term string, n int")


@pytest.mark.parametrize("seed,least_docs,ranks", [(1, 10, 10), (2, 3, 4), (3, 1, 1)])
def test_audit_equals_brute_force(spark, rows, seed, least_docs, ranks):
    docs = corpus(seed)
    assert rows(divergence.audit(frame(spark, docs), least_docs, ranks)) == brute(docs, least_docs, ranks)


def test_small_tiles_change_nothing(spark, rows):
    docs = corpus(4)
    df = frame(spark, docs)
    kept = divergence.kept_counts(df).cache()
    groups = divergence.group_sizes(df, kept).cache()
    want = [r for r in brute(docs, 10, 10) if r[2] == "pair"]
    for term_tile, source_tile in ((3, 2), (1, 1), (1000, 3)):
        got = divergence.source_pairs(kept, groups, term_tile, source_tile)
        assert rows(got) == sorted(((la, s, i, v, r) for la, s, _, i, v, r in want), key=repr)


def test_texts_are_cut_in_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    text = "Ab cd-é12 efghijklmnopqrst  u v\x00w ".encode() * 5
    assert [t.decode() for part in divergence._pieces(text) for t in part] == TERM.findall(text.decode().lower())


def test_shares_are_exact_beyond_the_range_of_a_long(spark):
    cases = [(9_000_000_000_000_000, 9_000_000_000_000_001, 3), (0, 0, 1), (5, 7, 2), (123456789012, 9876543210123, 1_000_000)]
    df = spark.createDataFrame(cases, "n long, total long, v long").select("n", "total", "v", divergence.share("n", "total", "v").alias("p"))
    assert {r["p"] for r in df.collect()} == {1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in cases}


def test_empty_table(spark, rows):
    assert rows(divergence.audit(frame(spark, [("a", "b", "c")]).limit(0))) == []
    assert rows(divergence.audit(frame(spark, [(None, None, None)]))) == []
