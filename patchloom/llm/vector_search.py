"""Exact top-k inner products by a vector-approximation file.

Every component becomes an integer and then one of 256 cells of its dimension; the cells
are one byte per component. A scan of the cells bounds each query's score with every
vector from below and above. What cannot reach the kth best lower bound is done with;
the exact vectors of the rest are read in the order of their upper bounds, first a
few, then those whose upper bound still reaches the kth exact score.

Equal vectors form one class, of which the ``k + 1`` smallest ids can be in a result.
Queries and classes are matched in blocks of fixed size, so neither side has to fit
anywhere whole. Vectors that are null or hold null, NaN or infinite components take no
part; a vector shorter than others, an empty one too, counts as padded with zeros; scores
must stay below 2^63; a row that repeats an
id with the same vector counts once. Rows with a null id take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from patchloom.llm.tools import stored

CELLS = 256
QUERY_BLOCK, VECTOR_BLOCK = 4096, 16384
# Queries bounded at a time inside a block.
TILE = 256
# Exact vectors read per query before the first check, as a multiple of k.
FIRST_READS = 3


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``id, v array<long>`` of the usable vectors."""
    x = F.col(vector_col)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    usable = df.filter(x.isNotNull() & F.col(id_col).isNotNull() & whole)
    return usable.select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long")).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Integer vectors as rows, padded with zeros."""
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
    size = np.diff(ends)
    if dims and (size == dims).all():
        return flat[ends[0] : ends[-1]].reshape(-1, dims)
    out = np.zeros((len(size), dims), np.int64)
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        out[k, : b - a] = flat[a:b]
    return out


def cell_marks(vectors: DataFrame) -> np.ndarray:
    """Least and greatest integer per dimension; one small row per dimension to the driver."""
    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            dims = int(np.diff(column.offsets.to_numpy()).max(initial=0))
            if dims:
                rows = _matrix(column, dims)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(dims, dtype=np.int64)), pa.array(rows.min(axis=0)), pa.array(rows.max(axis=0))],
                    ["dim", "least", "most"])

    parts = vectors.select("v").mapInArrow(extremes, "dim long, least long, most long")
    rows = parts.groupBy("dim").agg(F.min("least").alias("least"), F.max("most").alias("most")).orderBy("dim").collect()
    # zero is inside every range, for padding
    return np.array([(min(0, r["least"]), max(0, r["most"])) for r in rows], np.int64).reshape(-1, 2)


def to_cells(rows: np.ndarray, marks: np.ndarray) -> np.ndarray:
    return ((rows - marks[:, 0]) * CELLS // (marks[:, 1] - marks[:, 0] + 1)).astype(np.uint8)


def cell_edges(cells: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest integer of each cell."""
    width = marks[:, 1] - marks[:, 0] + 1
    c = cells.astype(np.int64)
    return marks[:, 0] - (-c * width // CELLS), marks[:, 0] - (-(c + 1) * width // CELLS) - 1


def _bounded(queries: DataFrame, classes: DataFrame, marks: np.ndarray, keep: int) -> DataFrame:
    """``query, id, low, high`` of the pairs that may be among the ``keep`` best of a block."""
    dims = len(marks)
    spark = classes.sparkSession
    n_queries, n_classes = queries.count(), classes.count()
    query_blocks, class_blocks = math.ceil(n_queries / QUERY_BLOCK) or 1, math.ceil(n_classes / VECTOR_BLOCK) or 1

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = to_cells(_matrix(batch.column(1), dims), marks)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c.tobytes() for c in cells], pa.binary())], ["id", "cells"])

    coded = classes.select("id", "v").mapInArrow(code, "id long, cells binary")
    left = queries.select(
        F.pmod(F.xxhash64("id"), F.lit(query_blocks)).alias("qb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(class_blocks - 1).cast("long"))).alias("cb"), "id", "v")
    right = coded.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("qb"),
        F.pmod(F.xxhash64("id"), F.lit(class_blocks)).alias("cb"), "id", "cells")

    def scan(key, asked: pa.Table, there: pa.Table) -> pa.Table:
        names = ["query", "id", "low", "high"]
        asked, there = asked.combine_chunks(), there.combine_chunks()
        parts = [[np.zeros(0, np.int64)] for _ in names]
        if asked.num_rows and there.num_rows:
            rows = _matrix(asked.column("v").combine_chunks(), dims)
            ids, own = there.column("id").to_numpy(), asked.column("id").to_numpy()
            cells = np.frombuffer(b"".join(there.column("cells").to_pylist()), np.uint8).reshape(len(ids), dims)
            low_edge, high_edge = (e.astype(np.float64).T for e in cell_edges(cells, marks))
            # sums of products of doubles are this much off at most, as a share of the sum of their sizes
            largest, share = np.maximum(np.abs(low_edge), np.abs(high_edge)), (dims + 2) * 2.0 ** -52
            for at in range(0, len(rows), TILE):
                plus, minus = np.maximum(rows[at : at + TILE], 0).astype(float), np.minimum(rows[at : at + TILE], 0).astype(float)
                slack = (plus - minus) @ largest * share
                low, high = plus @ low_edge + minus @ high_edge - slack, plus @ high_edge + minus @ low_edge + slack
                if low.shape[1] > keep:
                    floor = np.partition(low, low.shape[1] - keep, axis=1)[:, -keep]
                else:
                    floor = low.min(axis=1)
                q, c = np.nonzero(high >= floor[:, None])
                for part, values in zip(parts, (own[at : at + TILE][q], ids[c], np.floor(low[q, c]).astype(np.int64), np.ceil(high[q, c]).astype(np.int64))):
                    part.append(values)
        return pa.table([pa.array(np.concatenate(p)) for p in parts], names=names)

    pairs = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(scan, "query long, id long, low long, high long")
    return stored(pairs, "bounds")


def _scored(pairs: DataFrame, queries: DataFrame, classes: DataFrame) -> DataFrame:
    """``query, id, score`` from the exact vectors."""
    asked = queries.select(F.col("id").alias("query"), F.col("v").alias("_q"))
    there = classes.select("id", F.col("v").alias("_v"))
    product = F.aggregate(
        F.zip_with("_q", "_v", lambda a, b: F.coalesce(a * b, F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
    return pairs.select("query", "id").join(asked, "query").join(there, "id").select("query", "id", product.alias("score"))


def top_k(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: float = 256.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row whose id is divisible by ``every``."""
    vectors = stored(integer_vectors(df, id_col, vector_col, scale).distinct(), "vectors")
    classes = stored(vectors.groupBy("v").agg(F.min("id").alias("id")), "classes")
    few = Window.partitionBy("v").orderBy("id")
    # a rank limit, applied before the shuffle: at most k + 1 ids of a class
    members = stored(
        vectors.withColumn("nth", F.row_number().over(few)).filter(F.col("nth") <= k + 1)
        .select("v", F.col("id").alias("member")).join(classes, "v").select("id", "member"), "members")
    asked = stored(
        vectors.filter(F.col("id") % every == 0).withColumnRenamed("id", "query_id").join(classes, "v").select("query_id", "id"), "asked")
    queries = stored(classes.join(asked.select("id").distinct(), "id"), "queries")
    keep = k + 1  # one place is the query's own
    marks = cell_marks(classes)
    pairs = _bounded(queries, classes, marks, keep)
    by_low = Window.partitionBy("query").orderBy(F.desc("low"), "id")
    floor = pairs.withColumn("nth", F.row_number().over(by_low)).filter(F.col("nth") <= keep).groupBy("query").agg(F.min("low").alias("floor"))
    by_high = Window.partitionBy("query").orderBy(F.desc("high"), "id")
    able = stored(pairs.join(floor, "query").filter("high >= floor").withColumn("nth", F.row_number().over(by_high)), "able")
    first = stored(_scored(able.filter(F.col("nth") <= FIRST_READS * keep), queries, classes), "first")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    certain = first.withColumn("nth", F.row_number().over(by_score)).filter(F.col("nth") <= keep).groupBy("query").agg(
        F.min("score").alias("kth"))
    rest = able.filter(F.col("nth") > FIRST_READS * keep).join(certain, "query").filter("high >= kth")
    scored = first.unionByName(_scored(rest, queries, classes))
    best = scored.withColumn("nth", F.row_number().over(by_score)).filter(F.col("nth") <= keep).drop("nth")
    # ids of the best classes, cut to those that can be in a result of the class
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "member")
    ids = best.join(members, "id").withColumn("nth", F.row_number().over(ranked)).filter(F.col("nth") <= keep).select(
        F.col("query").alias("id"), "member", "score")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "member")
    found = asked.join(ids, "id").filter("member != query_id").withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", F.col("member").alias("vec_id"), "score")
