"""Benchmark passages in documents by q-gram counts in diagonal bands.

Texts are lower-cased and their white space becomes single blanks. An item of ``m``
bytes that lies in a document with at most ``k`` edits shares at least
``m + 1 - q - k * q`` of its q-grams with it, and all of those lie on ``2 * k + 1``
neighbouring diagonals. So shared q-grams are counted in overlapping bands of
diagonals; a region whose count meets the bound is aligned with the item inside
the band, and stays if it needs no more than ``k`` edits.

Items shorter than ``q`` bytes have no q-gram: they are looked up as they are, where no
letter, digit or underscore stands next to them. Null and empty items match nothing, as
do null and empty documents. Repeated rows give repeated hits.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from patchloom.llm.tools import held, portions

# Bytes of a q-gram; edits allowed per byte of an item.
Q = 10
BUDGET = 0.08
# Bytes of items that one broadcast holds; more items are matched in several blocks.
BLOCK_BYTES = 4_000_000
_FILTER_BITS = 22
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normal(text: str | None) -> bytes:
    return " ".join(text.lower().split()).encode() if text else b""


def edits_allowed(m: int, q: int, budget: float) -> int:
    """The budget's edits, but no more than leave one shared q-gram."""
    return max(0, min(int(m * budget), (m - q) // q))


def gram_codes(raw: np.ndarray, q: int) -> np.ndarray:
    """64-bit code of every q-gram of a byte string (8 <= q <= 16)."""
    n = len(raw) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = np.lib.stride_tricks.sliding_window_view(raw, 8)
    words = np.ascontiguousarray(eight).view(np.uint64).ravel()
    return (words[:n] * _C1) ^ (words[q - 8 : q - 8 + n] * _C2)


def banded_edits(item: bytes, text: bytes, low: int, high: int, most: int) -> int | None:
    """Fewest edits that turn ``item`` into a substring of ``text`` on diagonals
    ``low .. high`` (text place minus item place), or None if over ``most``."""
    infinite = most + 1
    row = {d: 0 for d in range(max(low, 0), min(high, len(text)) + 1)}
    for i, byte in enumerate(item, 1):
        new: dict[int, int] = {}
        for d in range(max(low, -i), min(high, len(text) - i) + 1):
            j = i + d
            best = row.get(d + 1, infinite) + 1
            if j > 0:
                best = min(best, row.get(d, infinite) + (text[j - 1] != byte), new.get(d - 1, infinite) + 1)
            if best <= most:
                new[d] = best
        if not new:
            return None
        row = new
    return min(row.values())


class Index:
    """q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, bytes]], q: int, budget: float):
        self.q = q
        self.items = [(key, text) for key, text in items if len(text) >= q]
        self.short: dict[bytes, list[int]] = {}
        for key, text in items:
            if 0 < len(text) < q:
                self.short.setdefault(text, []).append(key)
        # one look-ahead per length, as items can overlap
        by_size = [sorted(t for t in self.short if len(t) == n) for n in range(1, q)]
        self.lookups = [re.compile(b"(?<![0-9a-z_\x80-\xff])(?=(" + b"|".join(map(re.escape, t)) + b")(?![0-9a-z_\x80-\xff]))") for t in by_size if t]
        sizes = np.array([len(t) for _, t in self.items], np.int64)
        self.most = np.array([edits_allowed(m, q, budget) for m in sizes], np.int64)
        self.need = sizes + 1 - q - self.most * q
        self.width = 2 * self.most + 1
        codes = [gram_codes(np.frombuffer(t, np.uint8), q) for _, t in self.items]
        flat = np.concatenate([*codes, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        place = np.concatenate([*(np.arange(len(c)) for c in codes), np.zeros(0, np.int64)])
        order = np.argsort(flat, kind="stable")
        self.owner, self.place = owner[order].astype(np.int64), place[order].astype(np.int64)
        self.codes, self.first = np.unique(flat[order], return_index=True)
        self.times = np.diff(np.append(self.first, len(flat)))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self._slot(self.codes)] = True

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return ((codes * _C1) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def regions(self, raw: np.ndarray) -> list[tuple[int, int]]:
        """``(item, first diagonal of a band of two widths)`` that meet the bound."""
        codes = gram_codes(raw, self.q)
        at = np.flatnonzero(self.filter[self._slot(codes)])
        if not len(at) or not len(self.codes):
            return []
        found = np.searchsorted(self.codes, codes[at])
        found[found == len(self.codes)] = 0
        same = self.codes[found] == codes[at]
        at, found = at[same], found[same]
        times = self.times[found]
        total = int(times.sum())
        if not total:
            return []
        entry = np.arange(total) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self.first[found], times)
        item = self.owner[entry]
        cell = (np.repeat(at, times) - self.place[entry]) // self.width[item]
        span = len(raw) + 1_000_000
        cells, counts = np.unique(item * (2 * span) + cell + span, return_counts=True)
        follows = np.append(np.diff(cells) == 1, False)
        pair = counts + np.where(follows, np.append(counts[1:], 0), 0)
        item = cells // (2 * span)
        # a band of two widths starts at every cell; a lone cell is covered by its own band
        good = np.flatnonzero(pair >= self.need[item])
        return [(int(item[g]), int((cells[g] % (2 * span) - span) * self.width[item[g]])) for g in good]

    def hits(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        """Per text the hits ``(item key, start, end, edits)``, one per item and region."""
        gap = b"\x00" * self.q
        raw = np.frombuffer(gap.join(texts), np.uint8)
        starts = np.cumsum([0] + [len(t) + self.q for t in texts])
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        for item, low in self.regions(raw):
            key, pattern = self.items[item]
            high, most = low + 2 * int(self.width[item]) - 1, int(self.most[item])
            # the middle of the region is inside the text that holds it
            k = int(np.searchsorted(starts, (low + high + len(pattern)) // 2, side="right")) - 1
            if not 0 <= k < len(texts):
                continue
            low, high, text = low - int(starts[k]), high - int(starts[k]), texts[k]
            begin = max(0, low)
            exact = text.find(pattern, begin, max(0, high + len(pattern)))
            edits = 0 if exact >= 0 else banded_edits(pattern, text[begin : high + len(pattern)], low - begin, high - begin, most)
            if edits is None:
                continue
            start = exact if exact >= 0 else begin
            hit = (key, start, min(len(text), start + len(pattern) if exact >= 0 else high + len(pattern)), edits)
            if not any(h[0] == key and h[1] <= hit[2] and hit[1] <= h[2] and h[3] <= edits for h in out[k]):
                out[k].append(hit)
        for pattern in self.lookups:
            for hits, text in zip(out, texts):
                hits += [(key, m.start(), m.end(1), 0) for m in pattern.finditer(text) for key in self.short[m[1]]]
        return out


def _own_index(sent, q: int, budget: float) -> Index:
    """One index per worker process and block."""
    return held(("benchmark", hash(tuple(sent.value)), q, budget), lambda: Index(sent.value, q, budget))


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """Broadcasts of the items, each of about ``BLOCK_BYTES`` at most, by the summed size."""
    items = benchmark.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    count = math.ceil(size / (BLOCK_BYTES / 2)) if size > BLOCK_BYTES else 1
    for k in range(count):
        block = items.filter(F.pmod(F.xxhash64("key", "text"), F.lit(count)) == k) if count > 1 else items
        yield benchmark.sparkSession.sparkContext.broadcast([(r["key"], normal(r["text"])) for r in block.collect()])


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         q: int = Q, budget: float = BUDGET) -> DataFrame:
    """``id_col, item_id, start, end, edits``: places are bytes of the normalised text; with
    edits, the region rather than the exact ends."""
    kind = docs.schema[id_col].dataType
    out = None
    for sent in item_blocks(benchmark):
        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = _own_index(sent, q, budget)
            for batch in (part for b in batches for part in portions(b, 1)):
                found = index.hits([normal(t) for t in batch.column(1).to_pylist()])
                rows = [(k, *hit) for k, hits in enumerate(found) for hit in hits]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                     *(pa.array([r[c] for r in rows], pa.int64()) for c in (1, 2, 3, 4))],
                    [id_col, "item_id", "start", "end", "edits"])

        part = docs.select(id_col, text_col).mapInArrow(
            run, f"`{id_col}` {kind.simpleString()}, item_id long, start long, end long, edits long")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", q: int = Q, budget: float = BUDGET) -> DataFrame:
    """The rows of ``docs`` without any hit, all columns kept; no shuffle."""
    for sent in item_blocks(benchmark):
        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = _own_index(sent, q, budget)
            for batch in (part for b in batches for part in portions(b, text_col)):
                found = index.hits([normal(t) for t in batch.column(text_col).to_pylist()])
                yield batch.filter(pa.array([not hits for hits in found], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
