"""How far the sources of a language differ in the terms they use, and by which terms.

A language keeps the terms that at least ``least_docs`` of its documents hold (a document
is a row; rows that repeat an id count each). A group is a language and a source. Every
group and every language gives each kept term a smoothed share ``p`` in whole billionths,
and two shares differ by ``f = floor((p - q)^2 / (p + q))``. All of it is whole numbers.

Terms are ranked through count cells. All terms of a group with the same count there and
the same count in the language form one cell: ``f`` is worked out once per cell, equal
values are merged, the cells are ranked by how many terms stand before them, and only
cells that reach into the wanted ranks are expanded into terms, in UTF-8 order.

Pairs of sources are summed over tiles of terms and sources of fixed size. A tile holds
the shares of its sources as columns; equal columns are one cell with a multiplicity.
Terms that neither source's tile holds all have the same value and are added as one
product at the end.

Documents are counted per task before anything is shuffled, so a frequent term sends one
row per task and group. Null text, language and source count as ''. A group without
terms is a group; a language without kept terms gives its pairs the value 0 and no term
rows; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from patchloom.llm.tools import portions, stored

UNIT = 1_000_000_000
# Terms a task counts before it hands them on; bytes of a text cut into terms at a time.
HELD, PIECE = 400_000, 1 << 22
# Terms and sources of a tile.
TERM_TILE, SOURCE_TILE = 4096, 256

_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, a bounded part of it at a time."""
    plain, at = text.translate(_TERMS), 0
    while at < len(plain):
        to = plain.find(b" ", at + PIECE)
        to = len(plain) if to < 0 else to
        yield plain[at:to].split()
        at = to


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents, several rows per term."""
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (counts, within) in held.items():
                size = len(counts)
                if not size:
                    continue
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()),
                    pa.array(list(counts), pa.binary()).cast(pa.string()),
                    pa.array(list(counts.values()), pa.int64()), pa.array(list(map(within.__getitem__, counts)), pa.int64())], names)
            held.clear()

        for batch in (part for b in batches for part in portions(b, 2)):
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                seen: set[bytes] = set()
                for terms in _pieces(text):
                    counts, within = held.setdefault((lang, source), (Counter(), Counter()))
                    counts.update(terms)
                    seen.update(terms)
                if seen:
                    within.update(seen)
            if sum(len(counts) for counts, _ in held.values()) > HELD:
                yield from rows()
        yield from rows()

    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*plain).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_counts(docs: DataFrame, least_docs: int = 10) -> DataFrame:
    """``lang, source, term, n, total, head``: counts of kept terms in each group that holds
    them and in the language; ``head`` is 1 in one row of each term of a language."""
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    marked = counts.select(
        "lang", "source", "term", "n", F.sum("n").over(term).alias("total"), F.sum("docs").over(term).alias("docs"),
        F.when(F.row_number().over(term.orderBy("source")) == 1, 1).otherwise(0).alias("head"))
    return marked.filter(F.col("docs") >= least_docs).drop("docs")


def share(count: Column | str, total: Column | str, terms: Column | str) -> Column:
    """``1 + floor(UNIT * (count + 2) / (total + 2 * terms))``, exact for any long."""
    wide = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")
    above = (F.lit(UNIT).cast("decimal(10,0)") * (wide(count) + F.lit(2).cast("decimal(1,0)"))).cast("decimal(32,0)")
    below = (wide(total) + F.lit(2).cast("decimal(1,0)") * wide(terms)).cast("decimal(22,0)")
    return F.lit(1).cast("long") + F.call_function("div", above, below)


def differ(p: Column, q: Column) -> Column:
    """Shares are at most UNIT + 1, so their squared difference is a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang, source, at, sources, n, v, lang_n``: every group, its place among the sources of
    its language, occurrences of kept terms there and in the language, kept terms."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("head").alias("heads"))
    lang = Window.partitionBy("lang")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return named.join(own, ["lang", "source"], "left").select(
        "lang", "source", (F.row_number().over(lang.orderBy("source")) - 1).alias("at"), F.count(F.lit(1)).over(lang).alias("sources"),
        zero(F.col("n")).alias("n"), zero(F.sum("heads").over(lang)).alias("v"), zero(F.sum("n").over(lang)).alias("lang_n"))


def top_terms(kept: DataFrame, groups: DataFrame, ranks: int = 10) -> DataFrame:
    """``lang, source, item, value, rank`` of the terms a group uses more than its language."""
    cells = kept.groupBy("lang", "source", "n", "total").agg(F.count(F.lit(1)).alias("terms"))
    sizes = groups.select("lang", "source", F.col("n").alias("group_n"), "v", "lang_n")
    p, q = share("n", "group_n", "v"), share("total", "lang_n", "v")
    valued = cells.join(sizes, ["lang", "source"]).select("lang", "source", "n", "total", "terms", p.alias("p"), q.alias("q"))
    valued = valued.filter("p > q").select("lang", "source", "n", "total", "terms", differ(F.col("p"), F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    # a value holds at least one term, so no more values than ranks can matter
    merged = valued.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms")).withColumn(
        "nth", F.row_number().over(by_value)).filter(F.col("nth") <= ranks)
    before = F.coalesce(F.sum("terms").over(by_value.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    reached = merged.withColumn("before", before).filter(F.col("before") < ranks).select("lang", "source", "value", "before")
    chosen = valued.join(reached, ["lang", "source", "value"]).select("lang", "source", "n", "total", "value", "before")
    by_term = Window.partitionBy("lang", "source", "value").orderBy("term")
    listed = kept.join(chosen, ["lang", "source", "n", "total"]).withColumn("nth", F.row_number().over(by_term)).filter(F.col("nth") <= ranks)
    return listed.select("lang", "source", F.col("term").alias("item"), "value", (F.col("before") + F.col("nth")).cast("int").alias("rank")).filter(
        F.col("rank") <= ranks)


def _tile_sums(key: tuple[pa.Scalar, ...], rows: pa.Table, source_tile: int) -> pa.Table:
    """Sums over one tile of terms for all pairs of one or two tiles of sources.

    Rows without a term give the share of an absent term of each source."""
    lang, _, a, b = (k.as_py() for k in key)
    at, p = rows.column("at").to_numpy(), rows.column("p").to_numpy()
    codes = pa.concat_arrays(rows.column("term").chunks).dictionary_encode()
    of = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    terms = len(codes.dictionary)
    sources = np.sort(at[of < 0])
    row = np.searchsorted(sources, at)
    shares = np.empty((len(sources), terms), np.int64)
    shares[row[of < 0]] = p[of < 0][:, None]
    shares[row[of >= 0], of[of >= 0]] = p[of >= 0]
    cells, size = np.unique(shares, axis=1, return_counts=True) if terms else (shares, np.zeros(0, np.int64))
    tile = sources // source_tile
    first, second, value = [], [], []
    for k in range(len(sources)):
        if tile[k] != a:
            continue
        others = np.flatnonzero((tile == b) & (sources > sources[k]))
        gap = cells[others] - cells[k]
        value.append((gap * gap // (cells[others] + cells[k])) @ size)
        first.append(np.full(len(others), sources[k]))
        second.append(sources[others])
    join = lambda parts: np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)
    n = sum(map(len, first))
    return pa.table(
        [pa.array([lang] * n, pa.string()), pa.array(join(first)), pa.array(join(second)), pa.array(join(value)), pa.array(np.full(n, terms, np.int64))],
        names=["lang", "a", "b", "value", "seen"])


def source_pairs(kept: DataFrame, groups: DataFrame, term_tile: int = TERM_TILE, source_tile: int = SOURCE_TILE) -> DataFrame:
    """``lang, source, item, value, rank``: every other source of the language by distance."""
    absent = F.when(F.col("v") > 0, share(F.lit(0), "n", F.greatest("v", F.lit(1)))).otherwise(1)
    sized = groups.withColumn("tiles", F.ceil(F.col("v") / term_tile)).withColumn("p0", absent)
    there = sized.select("lang", "source", F.col("at").cast("long").alias("at"), "sources", F.col("n").alias("group_n"), "v", "tiles", "p0")
    held = kept.select("lang", "source", "term", "n").join(there, ["lang", "source"]).select(
        "lang", "at", "sources", F.pmod(F.xxhash64("term"), F.col("tiles")).alias("tile"), "term", share("n", "group_n", "v").alias("p"))
    blank = there.filter("v > 0").select(
        "lang", "at", "sources", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"),
        F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"))
    own = F.floor(F.col("at") / source_tile)
    last = F.floor((F.col("sources") - 1) / source_tile)
    spread = held.unionByName(blank).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    keyed = spread.select("lang", "tile", F.least(own, "other").alias("a"), F.greatest(own, "other").alias("b"), "at", "term", "p")

    def add(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return _tile_sums(key, rows, source_tile)

    parts = keyed.groupBy("lang", "tile", "a", "b").applyInArrow(add, "lang string, a long, b long, value long, seen long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("held"), F.sum("seen").alias("seen"))
    left = there.select("lang", "source", "at", "v", "p0")
    right = there.select("lang", F.col("source").alias("item"), F.col("at").alias("to"), F.col("p0").alias("q0"))
    both = left.join(right, "lang").filter("at != to").withColumn("a", F.least("at", "to")).withColumn("b", F.greatest("at", "to"))
    zero = F.lit(0).cast("long")
    rest = (F.col("v") - F.coalesce("seen", zero)) * differ(F.col("p0"), F.col("q0"))
    valued = both.join(sums, ["lang", "a", "b"], "left").select("lang", "source", "item", (F.coalesce("held", zero) + rest).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, least_docs: int = 10, ranks: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` and part ``term``."""
    kept = stored(kept_counts(docs, least_docs), "terms")
    groups = stored(group_sizes(docs, kept), "groups")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = source_pairs(kept, groups).withColumn("part", F.lit("pair")).select(columns)
    return pairs.unionByName(top_terms(kept, groups, ranks).withColumn("part", F.lit("term")).select(columns))
