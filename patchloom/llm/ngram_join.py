"""Documents whose word n-grams are similar, by vertical partitioning of a global order.

All n-grams stand in one global order: rare ones first, by a sketch of fixed size that
counts them over the whole corpus, then by hash. Two similar sets share at least ``c``
n-grams among the first few of each (the prefix); documents that do so are candidates.
The order is cut into fragments, every candidate set with it; overlaps are counted per
fragment and pair, summed per pair, and judged by the exact sizes.

Equal sets form one class, which is matched once. Candidates come in steps, so that
a large group of near copies never expands into all its pairs. First every class is
compared with the one class that leads most of its lists. Classes that stay apart from
the component of their leader are then held against it in blocks of bitmaps: each bit
is the parity of the n-grams that hash to it, so two bitmaps differ in no more bits
than the sets in n-grams, and only pairs whose bitmaps are near enough are compared,
the nearest few first, the others if they are still apart. Last, a class that shares
n-grams of its prefix with another group is held against that group in the same way. No
list is cut, and no list is expanded into pairs.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Null or empty texts have an empty
set and no links; a text of fewer words than the width is one n-gram. Rows with a
null id are matched, but never name a component; repeated rows give repeated rows.
Sets and n-grams are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from patchloom.llm.components import components
from patchloom.llm.tools import dropped, mix64, portions, shingle_hashes, stored, word_hashes

SKETCH_BITS, SKETCH_ROWS = 19, 2
SKETCH_BLOCK = 1 << 15
FRAGMENTS = 4
# Bits of the parity bitmap; nearest pairs compared first; classes per block that asks and per chunk that
# is asked; bitmap pairs compared at a time.
PARITY_BITS, NEAREST = 1024, 3
ASK_BLOCK, CHUNK, COMPARED = 1024, 16_384, 1 << 16
# A prefix holds 1 + n // AGREE n-grams more than one agreement needs.
AGREE = 50
MASK = (1 << 56) - 1


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of a text."""
    return np.unique(shingle_hashes(word_hashes(text.encode())[0], width)) if text else np.zeros(0, np.uint64)


def _slots(hashes: np.ndarray, row: int) -> np.ndarray:
    return ((hashes if row == 0 else mix64(hashes ^ np.uint64(row))) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def order_sketch(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """Logarithmic counts per slot over the whole corpus: ``SKETCH_ROWS * 2**SKETCH_BITS`` bytes
    on the driver, whatever the input."""
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((SKETCH_ROWS, size), np.int64)
        for batch in (part for b in batches for part in portions(b, 0)):
            sets = [shingle_set(t, width) for t in batch.column(0).to_pylist()]
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
            for row in range(SKETCH_ROWS):
                seen[row] += np.bincount(_slots(flat, row), minlength=size)
        blocks = seen.ravel().reshape(-1, SKETCH_BLOCK)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(blocks), dtype=np.int64)), pa.array([b.astype("<u4").tobytes() for b in blocks], pa.binary())],
            ["block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH_BLOCK, np.int64)
        for counts in table.column("counts").to_pylist():
            total += np.frombuffer(counts, "<u4")
        level = np.ceil(np.log2(total + 1) * 2).astype(np.uint8)
        return pa.table([table.column("block").slice(0, 1), pa.array([level.tobytes()], pa.binary())], names=["block", "counts"])

    parts = docs.select(text_col).mapInArrow(count, "block long, counts binary")
    rows = parts.groupBy("block").applyInArrow(add, "block long, counts binary").collect()
    found = {r["block"]: r["counts"] for r in rows}
    empty = bytes(SKETCH_BLOCK)
    count_blocks = SKETCH_ROWS * size // SKETCH_BLOCK
    return np.frombuffer(b"".join(found.get(k, empty) for k in range(count_blocks)), np.uint8).reshape(SKETCH_ROWS, size)


def _levels(hashes: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    level = sketch[0][_slots(hashes, 0)]
    for row in range(1, SKETCH_ROWS):
        level = np.minimum(level, sketch[row][_slots(hashes, row)])
    return level


def body_hash(hashes: np.ndarray) -> int:
    """56 bits of a set."""
    body = mix64(hashes ^ np.uint64(0x5BF03635)).sum(dtype=np.uint64) + np.uint64(len(hashes))
    return int(mix64(np.array([body], np.uint64))[0] >> np.uint64(8))


def parity(hashes: np.ndarray) -> bytes:
    return np.packbits(np.bincount((hashes & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1).tobytes()


def class_key(hashes: np.ndarray, levels: np.ndarray) -> int:
    """Identity of a set: 7 bits for how common its n-grams are (so that the largest key
    of a group is its most typical set), then its hash."""
    return min(127, int(levels.mean() * 2)) << 56 | body_hash(hashes)


def _needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _agreed(n: int) -> int:
    """N-grams that two similar sets share in their prefixes, if the smaller has ``n``."""
    return 1 + n // AGREE


def _enough(times: str, percent: int) -> Column:
    """Whether a set of ``n`` shares as many lists with others as a similar one would."""
    return F.col(times) >= 1 + F.floor(F.col("n") * percent / 100 / AGREE)


def _rows(docs: DataFrame, sent, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """``id, key, n, parity, prefix`` of every row; key is null for an empty set, and the prefix
    stands with the first row of a portion that has the set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in portions(b, 1)):
            sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            levels = [_levels(s, sent.value) for s in sets]
            keys = [class_key(s, at) if len(s) else None for s, at in zip(sets, levels)]
            prefixes, seen = [], {None}
            for key, s, at in zip(keys, sets, levels):
                n = len(s)
                take = min(n, n - _needed(n, percent) + _agreed(n))
                prefixes.append(None if key in seen else s[np.lexsort((s, at))[:take]].view(np.int64))
                seen.add(key)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([parity(s) for s in sets], pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                [id_col, "key", "n", "parity", "prefix"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, key long, n long, parity binary, prefix array<long>")


def _segments(texts: DataFrame, width: int) -> DataFrame:
    """``key, fragment, part`` from ``key, text``: a set cut where the order's fragments end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in portions(b, 1)):
            keys, parts = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes = shingle_set(text, width)
                if body_hash(hashes) != key & MASK:
                    continue  # another text under a repeated id
                # fragments of equal shares of the hash order
                ends = np.searchsorted(hashes, [np.uint64((k << 64) // FRAGMENTS) for k in range(1, FRAGMENTS)])
                keys.append(key)
                parts.extend(np.split(hashes.view(np.int64), ends))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.array(keys, np.int64), FRAGMENTS)),
                pa.array(np.tile(np.arange(FRAGMENTS, dtype=np.int32), len(keys))),
                pa.array(parts, pa.list_(pa.int64()))], ["key", "fragment", "part"])

    return texts.mapInArrow(run, "key long, fragment int, part array<long>")


def _near_pairs(asking: DataFrame, members: DataFrame, percent: int, nearest: int | None) -> DataFrame:
    """``a, b``: rows that ask a cluster (``cluster, key, n, place, parity``) with those of its members in
    other places whose bitmaps allow the similarity; with ``nearest``, only that many per row
    and chunk, the nearest first. Askers go in blocks, members in chunks, so a cluster of any
    size with few askers is sent about once."""
    asked = asking.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / ASK_BLOCK).cast("int").alias("blocks"))
    sizes = members.join(asked, "cluster").groupBy("cluster", "blocks").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    plan = stored(sizes, "asked")
    slot = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    row = ["key", "n", "place", "parity"]
    left = asking.join(plan, "cluster").select("cluster", slot("blocks").alias("block"), every("chunks").alias("chunk"), F.lit(True).alias("asks"), *row)
    right = members.join(plan, "cluster").select("cluster", every("blocks").alias("block"), slot("chunks").alias("chunk"), F.lit(False).alias("asks"), *row)

    def match(table: pa.Table) -> pa.Table:
        key, n, place, asks = (table.column(c).to_numpy() for c in ("key", "n", "place", "asks"))
        bits = np.frombuffer(b"".join(table.column("parity").to_pylist()), np.uint64).reshape(len(key), -1)
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, COMPARED // max(1, len(right)))
        for at in range(0, len(left) if len(right) else 0, step):
            rows = left[at : at + step]
            most = (n[rows][:, None] + n[right][None]) * (100 - percent) // (100 + percent)
            slack = most - np.bitwise_count(bits[rows][:, None] ^ bits[right][None]).sum(axis=2, dtype=np.int64)
            slack[place[rows][:, None] == place[right][None]] = -1
            if nearest is not None and slack.shape[1] > nearest:
                floor = np.partition(slack, slack.shape[1] - nearest, axis=1)[:, -nearest]
                good = (slack >= np.maximum(floor, 0)[:, None]) & (np.cumsum(slack >= floor[:, None], axis=1) <= 4 * nearest)
            else:
                good = slack >= 0
            x, y = np.nonzero(good)
            found[0].append(key[rows[x]])
            found[1].append(key[right[y]])
        a, b = np.concatenate(found[0]), np.concatenate(found[1])
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return left.unionByName(right).groupBy("cluster", "block", "chunk").applyInArrow(match, "a long, b long").distinct()


def _near(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sizes and bitmaps (``key, n, parity``) allow the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            bits = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(len(n_a), PARITY_BITS // 64) for c in ("p_a", "p_b")]
            good = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64) <= (n_a + n_b) * (100 - percent) // (100 + percent)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("a", "b")], ["a", "b"])

    both = pairs.join(bitmaps.toDF("a", "n_a", "p_a"), "a").join(bitmaps.toDF("b", "n_b", "p_b"), "b")
    return both.filter(_fits(F.col("n_a"), F.col("n_b"), percent)).select("a", "b", "n_a", "n_b", "p_a", "p_b").mapInArrow(run, "a long, b long")


def _outliers(members: DataFrame) -> DataFrame:
    """Members apart from the place that most members of their cluster share."""
    places = members.groupBy("cluster", "place").agg(F.count(F.lit(1)).alias("size"))
    main = places.groupBy("cluster").agg(F.max_by("place", F.struct("size", "place")).alias("main"), F.count(F.lit(1)).alias("places"))
    return members.join(main.filter("places > 1").select("cluster", "main"), "cluster").filter("place != main").drop("main")


def _fits(n_a: Column, n_b: Column, percent: int) -> Column:
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """``a, b, similar`` with exact overlaps: counted per fragment, summed per pair."""
    sizes = classes.select("key", "n", "first")
    sized = pairs.join(sizes.toDF("a", "n_a", "first_a"), "a").join(sizes.toDF("b", "n_b", "first_b"), "b")
    sized = stored(sized.filter(_fits(F.col("n_a"), F.col("n_b"), percent)), "pairs")
    wanted = sized.select(F.col("a").alias("key"), F.col("first_a").alias("_id")).union(sized.select("b", "first_b")).distinct()
    texts = docs.select(F.col(id_col).alias("_other"), F.col(text_col).alias("_text")).join(
        wanted, F.col("_other").eqNullSafe(F.col("_id"))).select("key", "_text")
    parts = stored(_segments(texts, width).dropDuplicates(["key", "fragment"]), "segments")
    split = sized.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
    joined = split.join(parts.toDF("a", "fragment", "part_a"), ["a", "fragment"]).join(
        parts.toDF("b", "fragment", "part_b"), ["b", "fragment"])
    partial = joined.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("part_a", "part_b")).alias("shared"))
    total = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("shared").alias("shared"))
    done = stored(total.select("a", "b", (
        F.col("shared") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("shared")) * percent).alias("similar")), "verified")
    dropped(parts)
    dropped(sized)
    return done


def similar_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, n_links`` for every row; links join classes with
    ``100 * intersection >= percent * union``; ``n_links`` counts the links to other classes
    that were drawn, at least one where there is any."""
    spark = docs.sparkSession
    docs = docs.select(id_col, text_col)
    sent = spark.sparkContext.broadcast(order_sketch(docs, text_col, width))
    cut = stored(_rows(docs, sent, id_col, text_col, width, percent), "cut")
    rows = stored(cut.drop("prefix"), "rows")
    classes = stored(rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("n").alias("n"), F.min(id_col).alias("first")), "classes")

    postings = cut.filter("prefix IS NOT NULL").select(F.explode("prefix").alias("token"), "key")
    lists = postings.groupBy("token").agg(F.max("key").alias("lead"), F.min("key").alias("least")).filter("lead != least")
    # lists of one class are done with here; the shuffle files go before the others are read
    lists = stored(lists.select("token", "lead"), "lists")
    live = stored(postings.join(lists, "token").distinct(), "postings")
    dropped(lists)
    dropped(cut)

    # a class in fewer lists than two similar sets share is similar to none
    held = live.groupBy("key").agg(F.count(F.lit(1)).alias("times")).join(classes.select("key", "n"), "key").filter(
        _enough("times", percent)).select("key", "n")
    able = stored(rows.select("key", "parity").join(held, "key").dropDuplicates(["key"]).select("key", "n", "parity"), "able")

    # every class with the class that leads most of its lists
    led = live.filter("key != lead").groupBy("key", "lead").agg(F.count(F.lit(1)).alias("times"))
    best = stored(led.groupBy("key").agg(F.max_by("lead", F.struct("times", "lead")).alias("lead"), F.max("times").alias("times")), "leaders")
    star = best.join(able.select("key", "n"), "key").filter(F.col("times") * AGREE >= F.col("n") / 4)
    star = _near(star.select(F.col("key").alias("a"), F.col("lead").alias("b")), able, percent)
    check = lambda pairs: _verified(pairs, docs, classes, id_col, text_col, width, percent)
    links = check(star).filter("similar").select("a", "b")
    labels = components(links)

    # classes apart from the component of their leader, against that component
    first = labels.select(F.col("node").alias("key"), "component")
    # every class with enough lists, also one that leads lists but is nobody's best leader
    own = able.select("key", "n").join(best.select("key", "lead"), "key", "left").join(first, "key", "left").join(
        first.toDF("lead", "lead_component"), "lead", "left").select(
        "key", "n", F.coalesce("component", "lead_component", "lead", "key").alias("cluster"))
    clusters = stored(own, "clusters")
    bitmaps = able.select("key", "parity")

    def placed(df: DataFrame) -> DataFrame:
        return df.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn(
            "place", F.coalesce("component", "key")).drop("component")

    tested = None
    for nearest in (NEAREST, None):
        members = stored(placed(clusters).join(bitmaps, "key").select("cluster", "key", "n", "place", "parity"), "members")
        pairs = _near_pairs(_outliers(members), members, percent, nearest)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        tested = check(pairs)
        dropped(members)
        links = stored(links.unionByName(tested.filter("similar").select("a", "b")), "links")
        labels = components(links)

    # classes that share n-grams of their prefixes with a cluster other than their own, against that cluster:
    # of two clusters the members of the smaller ask, in every list
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    ranked = clusters.join(sizes, "cluster").select("key", "n", F.struct("size", "cluster").alias("own"))
    spread = live.select("token", "key").join(ranked, "key")
    mixed = spread.groupBy("token").agg(F.min("own").alias("low"), F.max("own").alias("high")).filter("low != high")
    crowd = stored(spread.join(mixed.select("token"), "token", "left_semi"), "crowd")
    dropped(live)
    # the lists of classes that are in enough of them
    crowd_of = crowd.groupBy("key", "n").agg(F.count(F.lit(1)).alias("times")).filter(_enough("times", percent)).select("key")
    there = stored(crowd.join(crowd_of, "key", "left_semi"), "there")
    dropped(crowd)
    asked = there.select("token", F.col("own").alias("other")).distinct()
    met = there.join(asked, "token").filter("own < other").groupBy("key", "n", "other").agg(
        F.count(F.lit(1)).alias("times")).filter(_enough("times", percent)).select("key", F.col("other.cluster").alias("cluster"))
    members = stored(placed(clusters).join(bitmaps, "key").select("cluster", "key", "n", "place", "parity"), "members")
    asking = stored(met.join(members.select("key", "n", "place", "parity"), "key").select("cluster", "key", "n", "place", "parity"), "asking")
    dropped(there)
    more = check(_near_pairs(asking, members, percent, None)).filter("similar").select("a", "b")
    links = stored(links.unionByName(more), "links")
    labels = components(links)

    ends = links.select(F.col("a").alias("key")).union(links.select("b")).groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
    known = classes.join(labels.withColumnRenamed("node", "key"), "key", "left").join(ends, "key", "left").select(
        "key", "first", F.coalesce("component", "key").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    least = known.groupBy("component").agg(F.min("first").alias("component_id"))
    named = known.join(least, "component").select("key", "component_id", "n_links")
    return rows.join(named, "key", "left").select(
        id_col, F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNull(), F.col(id_col)).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
