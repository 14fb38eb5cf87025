"""Near copies by SimHash: tiled exact comparison of all fingerprints.

A text's fingerprint has a bit set where more than half of its shingle hashes have it.
Equal fingerprints are one node. Nodes lie in tiles by the number of their set bits,
large counts in several tiles by hash. Two tiles are compared only if their counts
differ by no more than the radius: flipping one bit changes a count by one. Inside a
pair of tiles the same test runs on the counts of the four 16-bit parts, whose
differences add up to the radius at most; what is left is compared one by one with
exclusive-or and bit counts in numpy. Every pair within the radius is met.

A pair of tiles returns no pairs but a forest that connects what is linked there, so a
group of near copies gives no more rows than it has members per pair of tiles. Rows of
the comparison grow with the square of the fingerprints, work by about a twentieth of it.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Null texts and texts without words
have fingerprint zero and are linked like any other. Rows with a null id are matched
but never name a component (null where no member has an id); repeated rows give
repeated rows; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from patchloom.llm.components import components
from patchloom.llm.tools import buckets_of, portions, stored

SEED = 42
# Fingerprints per tile (8 bytes each); pairs compared at a time; shingles hashed at a time.
TILE, PAIRS, SHINGLES = 1 << 20, 1 << 21, 1 << 18

_PLAIN = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\x0b\x0c\r", bytes(range(97, 123)) + b" " * 5)
_SPACES = re.compile(rb"  +")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 of every run of ``width`` words joined by one space, repeats included, a part at a
    time; of the whole sequence where there are fewer words, nothing where there are none."""
    plain = _SPACES.sub(b" ", text.translate(_PLAIN)).strip(b" ")
    if not plain:
        return
    gaps = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(plain)]])
    if len(starts) > width:
        starts, ends = starts[: len(starts) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    one = xxhash.xxh64_intdigest
    for at in range(0, len(starts), SHINGLES):
        a, b = starts[at : at + SHINGLES].tolist(), ends[at : at + SHINGLES].tolist()
        yield np.fromiter((one(plain[x:y], SEED) for x, y in zip(a, b)), np.uint64, len(a))


def fingerprints_of(texts: list[bytes | None], width: int) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text; bits are counted through the bytes of the hashes."""
    ones, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[tuple[int, np.ndarray]] = []

    def count() -> None:
        if not held:
            return
        rows, own = np.unique([k for k, _ in held], return_inverse=True)
        hashes, doc = np.concatenate([h for _, h in held]), np.repeat(own, [len(h) for _, h in held])
        for b, column in enumerate(hashes.astype("<u8").view(np.uint8).reshape(-1, 8).T):
            seen = np.bincount(doc * 256 + column, minlength=256 * len(rows)).reshape(-1, 256)
            ones[rows, 8 * b : 8 * b + 8] += seen @ _BITS
        total[rows] += np.bincount(doc)
        held.clear()

    waiting = 0
    for k, text in enumerate(texts):
        for part in shingle_hashes(text or b"", width):
            held.append((k, part))
            waiting += len(part)
            if waiting >= SHINGLES:
                count()
                waiting = 0
    count()
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, print long`` per row; the 64 bits as a signed number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in portions(b, 1)):
            prints = fingerprints_of(batch.column(1).cast(pa.binary()).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], [id_col, "print"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, print long")


class Forest:
    """Union of numbered nodes; the root of a tree is its smallest node."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            p, q = self.root[a], self.root[b]
            apart = p != q
            if not apart.any():
                return
            a, b, p, q = a[apart], b[apart], p[apart], q[apart]
            np.minimum.at(self.root, np.maximum(p, q), np.minimum(p, q))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _cells(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the bit counts of the four parts, the counts of each cell, its size."""
    parts = np.bitwise_count(prints.view(np.uint16).reshape(-1, 4)).astype(np.int64)
    order = np.lexsort(parts.T)
    parts = parts[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(parts, axis=0) != 0).any(axis=1)]))
    return order, parts[first], np.diff(np.concatenate([first, [len(prints)]]))


def linked(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest over the links between ``left`` and ``right``, or within ``left``."""
    if not len(left) or right is not None and not len(right):
        return left[:0], left[:0]
    order, counts, size = _cells(left)
    left = left[order]
    if right is None:
        other, other_counts, other_size, base = left, counts, size, 0
    else:
        order, other_counts, other_size = _cells(right)
        other, base = right[order], len(left)
    nodes = left if right is None else np.concatenate([left, other])
    forest, ends = Forest(len(nodes)), np.cumsum(size)
    for k in range(len(size)):
        near = np.abs(other_counts - counts[k]).sum(axis=1) <= radius
        if right is None:
            near[:k] = False
        at = np.flatnonzero(np.repeat(near, other_size))
        if not len(at):
            continue
        there, step = other[at], max(1, PAIRS // len(at))
        for a in range(ends[k] - size[k], ends[k], step):
            here = left[a : min(a + step, ends[k])]
            i, j = np.nonzero(np.bitwise_count(here[:, None] ^ there[None, :]) <= radius)
            forest.join(i + a, at[j] + base)
    apart = np.flatnonzero(forest.root != np.arange(len(nodes)))
    return nodes[apart], nodes[forest.root[apart]]


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """``a, b``: edges that connect the distinct fingerprints within ``radius`` of each other."""
    spark = prints.sparkSession
    nodes = stored(prints.select("print").distinct().withColumn("p", F.bit_count("print")), "prints")
    tiles = {r["p"]: math.ceil(r["count"] / TILE) for r in nodes.groupBy("p").count().collect()}  # 65 rows at most
    partners = [(p, q, j, k) for p in tiles for q in range(p, p + radius + 1) if q in tiles for j in range(tiles[p]) for k in range(tiles[q])
                if p < q or j <= k]
    edges = "a long, b long"
    if not partners:
        return spark.createDataFrame([], edges)
    pairs = spark.createDataFrame(partners, "p int, q int, j int, k int")
    of_p = F.element_at(F.create_map(*[F.lit(x) for p, n in tiles.items() for x in (p, n)]), F.col("p"))
    there = nodes.withColumn("j", F.pmod(F.xxhash64("print"), of_p).cast("int"))
    first = there.join(pairs, ["p", "j"]).select("p", "j", "q", "k", F.lit(False).alias("second"), "print")
    second = there.select(F.col("p").alias("q"), F.col("j").alias("k"), "print").join(pairs.filter("p != q OR j != k"), ["q", "k"]).select(
        "p", "j", "q", "k", F.lit(True).alias("second"), "print")

    def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        marks, values = rows.column("second").to_numpy(), rows.column("print").to_numpy().view(np.uint64)
        diagonal = key[0].as_py() == key[2].as_py() and key[1].as_py() == key[3].as_py()
        a, b = linked(values[~marks], None if diagonal else values[marks], radius)
        return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    keys = ["p", "j", "q", "k"]
    tasks = max(buckets_of(spark), len(partners) // 4)
    return first.unionByName(second).repartition(tasks, *keys).groupBy(*keys).applyInArrow(compare, edges)


def near_copies(docs: DataFrame, radius: int = 3, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint, component_id``: the component is named by its smallest id."""
    prints = stored(fingerprints(docs, width, id_col, text_col), "fingerprints")
    groups = components(stored(links(prints, radius), "links"))
    least = prints.groupBy("print").agg(F.min(id_col).alias("least"))
    named = stored(
        least.join(groups.withColumnRenamed("node", "print"), "print", "left")
        .select("print", F.coalesce("component", "print").alias("component"), "least"), "named")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    place = named.join(smallest, "component").select("print", "component_id")
    digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return prints.join(place, "print").select(id_col, digits.alias("fingerprint"), "component_id")
