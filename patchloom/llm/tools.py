"""Shared helpers of the corpus operators: tables, written intermediates, vectorised hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from patchloom.session import dropped, remove_at_exit, shuffles_removed, stored, work_path  # noqa: F401

_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """``stored`` as a table in buckets of ``key``: later joins by it leave these rows in place.
    ``df`` comes partitioned by ``key`` into ``buckets_of`` partitions, so that a task writes one file."""
    spark = df.sparkSession
    path = work_path(spark, label)
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    with shuffles_removed(spark):
        df.write.bucketBy(buckets_of(spark), key).option("path", path).option("compression", "zstd").saveAsTable(name)
    remove_at_exit(spark, path)
    return spark.table(name)


_held: dict = {}


def held(key, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks: one model or index at a time, so a worker that
    goes from one operator to the next holds only the last one's."""
    if _held.get("key") != key:
        _held.clear()
        _held.update(key=key, value=make())
    return _held["value"]


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64 (wraps around)."""
    x = x + _GOLDEN
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64))
WORD_BASE = np.uint64(0xD1342543DE82EF95)


_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = WORD_BASE) -> np.ndarray:
    """``base ** 0 .. base ** (n-1)`` modulo 2^64; kept, so that a long text pays once."""
    held = _powers.get(int(base))
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 14), base, dtype=np.uint64)
        held[0] = 1
        held = _powers[int(base)] = np.multiply.accumulate(held)
    return held[:n]


INVERSE = np.uint64(pow(int(WORD_BASE), -1, 1 << 64))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end of every word ``[^\\x20\\x09-\\x0D]+``; A-Z are lower-cased."""
    raw = np.frombuffer(text, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODES[_LOWER[raw]] * powers(len(raw)), out=sums[1:])
    shift = powers(int(start[-1]) + 1 if len(start) else 0, INVERSE)
    return mix64((sums[end] - sums[start]) * shift[start] + (end - start).astype(np.uint64)), start, end


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; of the whole sequence where there are fewer."""
    if len(words) == 0:
        return words
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for k in range(width):
        out = mix64(out + words[k : len(words) - width + 1 + k])
    return out


def portions(batch: pa.RecordBatch, column: int | str, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``size`` bytes each; one text stays whole."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(at, to - at)
        at = to
