"""SimHash fingerprints and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from patchloom.llm import simhash


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_print(text, width):
    words = words_of(text)
    runs = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(docs, radius, width):
    prints = [brute_print(t, width) for _, t in docs]
    root = list(range(len(docs)))
    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for a in range(len(docs)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(docs):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return sorted(((d, f"{p:016x}", least.get(find(k))) for k, ((d, _), p) in enumerate(zip(docs, prints))), key=repr)


def corpus(seed, copies=20):
    rng = random.Random(seed)
    docs = [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one\x0b"), (905, "one TWO"), (None, "only one row has no id"), (None, "ONE")]
    for _ in range(8):
        base = [f"wörd{rng.randint(0, 500)}" for _ in range(rng.choice([1, 5, 60, 150]))]
        for _ in range(rng.randint(1, copies)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"new{rng.randint(0, 50)}"
            docs.append((len(docs) * 7 + 1, rng.choice([" ", "\n", "  \t"]).join(words)))
    docs += [docs[-1], docs[-1], (5, docs[-2][1])]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed,radius,width,tile", [(1, 3, 3, 1 << 20), (2, 3, 3, 2), (3, 6, 1, 3), (4, 0, 2, 1 << 20)])
def test_components_equal_brute_force(spark, documents, rows, monkeypatch, seed, radius, width, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    docs = corpus(seed)
    got = rows(simhash.near_copies(documents(*docs), radius, width), "doc_id", "fingerprint", "component_id")
    assert got == brute(docs, radius, width)


def test_every_pair_of_near_fingerprints_is_met():
    rng = random.Random(9)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    near = lambda: np.unique(np.array([flip(rng.choice(seeds), rng.randint(0, 4)) for _ in range(300)], np.uint64))
    left, right = near(), near()
    for a, b in ((left, None), (left, right)):
        nodes = a if b is None else np.concatenate([a, b])
        got, want = simhash.Forest(len(nodes)), simhash.Forest(len(nodes))
        at = {int(v): k for k, v in enumerate(nodes)} if b is None else None
        x, y = simhash.linked(a, b, 3)
        if at is not None:
            got.join(np.array([at[int(v)] for v in x], int), np.array([at[int(v)] for v in y], int))
            i, j = np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3)
            want.join(i, j)
            assert (got.root == want.root).all()
        else:
            assert all(int(p ^ q).bit_count() <= 64 for p, q in zip(x, y))
            i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= 3)
            want.join(i, j + len(a))
            assert len(x) == (want.root != np.arange(len(nodes))).sum()


def test_a_large_group_gives_a_forest():
    base = np.uint64(0x0123456789ABCDEF)
    one = np.array([base ^ np.uint64(1 << b) for b in range(64)], np.uint64)
    a, b = simhash.linked(one, None, 3)
    assert len(a) == 63


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = " ".join(f"w{k % 37}" for k in range(5000)).encode()
    whole = simhash.fingerprints_of([text, None, b"a"], 3)
    monkeypatch.setattr(simhash, "SHINGLES", 100)
    assert (simhash.fingerprints_of([text, None, b"a"], 3) == whole).all()
    assert int(whole[0]) == brute_print(text.decode(), 3) and whole[1] == 0


def test_empty_table(spark, documents, rows):
    assert rows(simhash.near_copies(documents((1, "a")).limit(0))) == []
    assert rows(simhash.near_copies(documents((3, None), (2, None)))) == [(2, "0" * 16, 2), (3, "0" * 16, 2)]
