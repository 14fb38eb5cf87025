"""Bytes that repeat an earlier string of ``length`` bytes, by difference-cover samples.

A difference cover modulo ``v`` is a set of residues such that any two places reach a
common pair of covered places by one shift below ``v``. So two equal strings of
``length`` bytes hold, at the same shift, two covered places whose next
``length - v + 1`` bytes are equal: sorting the covered suffixes alone finds every
long tie. They are sorted one bucket of hashed prefixes at a time, as packed
fingerprints; a bucket's size is fixed and the number of buckets grows with the
corpus, which bounds memory.

Covered suffixes that occur twice get a rank: the document in which their whole
context (``v - 1`` bytes before, ``length`` after) comes first. A suffix whose context
came before settles, by that rank, all strings around it at once. What is left are the
places where one prefix goes on in different contexts, the ends of repeats; only
there are single strings of ``length`` bytes compared.

Documents are ordered by id. Null and empty texts have no bytes; texts shorter than
``length`` lose none. A row with a null id has no place in the order and keeps all its
bytes; rows that share an id are not earlier than each other. Strings are known by
64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from patchloom.llm.tools import BYTE_CODES, INVERSE, bucketed, buckets_of, dropped, mix64, portions, powers, stored

# Perfect difference covers, modulus to residues.
COVERS = {
    7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52), 73: (0, 1, 3, 7, 15, 31, 36, 54, 63),
}
# Covered suffixes per bucket, on average.
BUCKET_ROWS = 2_000_000


class Cover:
    """Places, contexts and hashes for strings of one length."""

    def __init__(self, length: int):
        if min(COVERS) > length * 0.6:
            raise ValueError(f"length must be at least {math.ceil(min(COVERS) / 0.6)}")
        # a third of the length: fewer residues would leave more strings at the ends of repeats
        self.length, self.v = length, max([v for v in COVERS if v <= length * 0.35], default=min(COVERS))
        self.residues = np.array(COVERS[self.v])
        self.prefix = length - self.v + 1

    def count(self, n: int) -> int:
        """Covered places of a text of ``n`` bytes that a string can need."""
        if n < self.length:
            return 0
        turns, rest = divmod(n - self.prefix, self.v)
        return turns * len(self.residues) + int(np.searchsorted(self.residues, rest, side="right"))

    def places(self, index: np.ndarray) -> np.ndarray:
        turns, k = np.divmod(index, len(self.residues))
        return turns * self.v + self.residues[k]


class Hashes:
    """Hashes of any substrings of one text."""

    def __init__(self, raw: np.ndarray):
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE_CODES[raw] * powers(len(raw)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        shift = powers(len(self.sums), INVERSE)
        return mix64((self.sums[end] - self.sums[start]) * shift[start])


def _firsts(values: np.ndarray) -> np.ndarray:
    """True where a value stands for the first time."""
    out = np.zeros(len(values), bool)
    out[np.unique(values, return_index=True)[1]] = True
    return out


def _packed(bucket: int, order: np.ndarray, docs: np.ndarray, index: np.ndarray, marks: np.ndarray) -> tuple:
    """One row: documents with their number of entries, marks and places of the entries."""
    own = docs[order]
    cut = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    places = index[order]
    kind = "<u2" if not len(places) or places.max() < 65536 else "<u4"
    return (bucket, own[cut], np.diff(np.append(cut, len(own))), marks[order].astype("<u4").tobytes(), places.astype(kind).tobytes())


def _bucket_rows(ids: list[int], texts: list[bytes], cover: Cover, buckets: int) -> list[tuple]:
    """Packed fingerprints of a portion's covered suffixes by bucket. Of equal ones only the
    first is sent; they are known to repeat and go to buckets of negative number."""
    docs, index, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for doc, text in zip(ids, texts):
        n = cover.count(len(text))
        if n:
            at = np.arange(n)
            p = cover.places(at)
            hashes.append(Hashes(np.frombuffer(text, np.uint8)).of(p, p + cover.prefix))
            index.append(at)
            docs.append(np.full(n, doc, np.int64))
    docs, index, hashes = np.concatenate(docs), np.concatenate(index), np.concatenate(hashes)
    if not len(docs):
        return []
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    marks = hashes & np.uint64(0xFFFFFFFF)
    _, first, group, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    sent = np.zeros(len(docs), bool)
    sent[first] = True
    out = []
    order = np.flatnonzero(sent)
    order = order[np.argsort(bucket[order], kind="stable")]
    cut = np.append(np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)), len(order))
    for a, b in zip(cut[:-1], cut[1:]):
        out.append(_packed(int(bucket[order[a]]), order[a:b], docs, index, marks))
    known = np.flatnonzero(times[group] > 1)
    if len(known):
        out.append(_packed(-1 - int(hashes[0] % np.uint64(buckets)), known, docs, index, marks))
    return out


_PACKED = "bucket long, docs array<long>, counts array<int>, marks binary, places binary"
_SHARE = "share long, docs array<long>, counts array<int>, places binary"


def _shares(docs: np.ndarray, places: np.ndarray, shares: int) -> pa.Table:
    """Places by the share their document falls into, one row per share."""
    share = (mix64(docs.view(np.uint64)) % np.uint64(shares)).astype(np.int64)
    order = np.lexsort((docs, share))
    share, docs, places = share[order], docs[order], places[order]
    cut = np.append(np.flatnonzero(np.append(True, np.diff(share) != 0)), len(share)) if len(share) else np.zeros(1, np.int64)
    out = []
    for a, b in zip(cut[:-1], cut[1:]):
        at = np.flatnonzero(np.append(True, np.diff(docs[a:b]) != 0))
        out.append((int(share[a]), docs[a:b][at], np.diff(np.append(at, b - a)).astype(np.int32), places[a:b].astype("<u4").tobytes()))
    return pa.table([
        pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.int64())),
        pa.array([o[2] for o in out], pa.list_(pa.int32())), pa.array([o[3] for o in out], pa.binary())], ["share", "docs", "counts", "places"])


def repeated_places(docs: DataFrame, cover: Cover, buckets: int) -> DataFrame:
    """``id, places array<binary>``: numbers of covered places whose prefix occurs twice.

    A bucket answers with one row per share of the documents, and there are as many shares as
    buckets; a share then gives one row per document."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in portions(b, 1, 4_000_000)):
            rows = _bucket_rows(batch.column(0).to_pylist(), [t.encode() for t in batch.column(1).to_pylist()], cover, buckets)
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                pa.array([r[2].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[3] for r in rows], pa.binary()),
                pa.array([r[4] for r in rows], pa.binary())], ["bucket", "docs", "counts", "marks", "places"])

    def sort_bucket(table: pa.Table) -> pa.Table:
        known = table.column("bucket")[0].as_py() < 0
        docs, marks, places = [], [], []
        for row in table.to_pylist():
            m = np.frombuffer(row["marks"], "<u4")
            kind = "<u2" if len(row["places"]) == 2 * len(m) else "<u4"
            marks.append(m)
            places.append(np.frombuffer(row["places"], kind).astype("<u4"))
            docs.append(np.repeat(np.array(row["docs"], np.int64), row["counts"]))
        docs, marks, places = np.concatenate(docs), np.concatenate(marks), np.concatenate(places)
        if not known:
            order = np.argsort(marks, kind="stable")
            same = np.diff(marks[order]) == 0
            tied = order[np.append(same, False) | np.append(False, same)]
            docs, places = docs[tied], places[tied]
        return _shares(docs, places, buckets)

    def gather(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        docs = np.concatenate([np.repeat(np.array(d, np.int64), n) for d, n in zip(rows["docs"], rows["counts"])])
        places = np.concatenate([np.frombuffer(p, "<u4") for p in rows["places"]])
        order = np.argsort(docs, kind="stable")
        docs, places = docs[order], places[order]
        at = np.flatnonzero(np.append(True, np.diff(docs) != 0))
        ends = np.append(at[1:], len(docs))
        # what one document holds: bounded by its text
        held = [[places[a:b].tobytes()] for a, b in zip(at, ends)]
        return pa.table([pa.array(docs[at]), pa.array(held, pa.list_(pa.binary()))], names=["id", "places"])

    packed = docs.filter(F.octet_length("text") >= cover.length).select("id", "text").mapInArrow(cut, _PACKED)
    found = packed.groupBy("bucket").applyInArrow(sort_bucket, _SHARE)
    return found.groupBy("share").applyInArrow(gather, "id long, places array<binary>")


class Doc:
    """One text with its repeated covered places and the hashes that tell them apart."""

    def __init__(self, text: str, places: list[bytes], cover: Cover):
        self.cover, self.raw = cover, np.frombuffer(text.encode(), np.uint8)
        n = len(self.raw)
        self.hashes = Hashes(self.raw)
        index = np.unique(np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(p, "<u4") for p in places)])).astype(np.int64)
        # places of another text under the same id may lie beyond this one
        self.p = cover.places(index[index < cover.count(n)])
        low, high = np.maximum(self.p - (cover.v - 1), 0), np.minimum(self.p + cover.length, n)
        self.key = self.hashes.of(self.p, self.p + cover.prefix)
        shape = (self.p - low).astype(np.uint64) << np.uint64(32) | (high - self.p).astype(np.uint64)
        self.context = mix64(self.hashes.of(low, high) ^ mix64(shape))
        self.first = _firsts(self.context)

    def windows(self, which: np.ndarray) -> np.ndarray:
        """True for the starts of all strings around the places ``which``."""
        n = len(self.raw)
        change = np.zeros(n + 2, np.int32)
        low = np.maximum(self.p[which] - (self.cover.v - 1), 0)
        high = np.minimum(self.p[which], n - self.cover.length)
        good = low <= high
        np.add.at(change, low[good], 1)
        np.add.at(change, high[good] + 1, -1)
        return np.cumsum(change)[:n] > 0

    def settled(self, leads) -> np.ndarray:
        """Starts of strings whose whole surroundings came before."""
        return self.windows(~(self.first & np.isin(self.context, _uint(leads))))

    def open_strings(self, leads, forks) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the strings that have to be compared one by one."""
        able = self.windows(self.first & np.isin(self.context, _uint(forks)))
        at = np.flatnonzero(able & ~self.settled(leads))
        return at, self.hashes.of(at, at + self.cover.length)


def _uint(values) -> np.ndarray:
    return np.array(values or [], np.int64).view(np.uint64)


def _per_doc(df: DataFrame, columns: list[str], make, schema: str) -> DataFrame:
    """``make(rows)`` over portions of rows that carry a text; rows are dictionaries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in portions(b, "text")):
            yield make(batch.to_pylist())

    return df.select(*columns).mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256, spans`` for every row: ``spans`` holds
    the removed runs as ``start, end`` (bytes)."""
    cover = Cover(length)
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    rows = stored(given.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "rows")
    # of equal texts the first stands for all: the others are repeats from end to end
    leaders = rows.filter("id IS NOT NULL").groupBy("sha").agg(F.min("id").alias("leader"))
    marked = stored(rows.join(leaders, "sha", "left"), "marked")
    size = marked.agg(F.sum("n_bytes")).head()[0] or 0
    buckets = max(8, math.ceil(size / cover.v * len(cover.residues) / BUCKET_ROWS))
    own = given.filter("id IS NOT NULL")
    places = stored(repeated_places(own, cover, buckets), "places")
    leading = marked.filter("id = leader").select("id").distinct()
    repeated = places.join(leading, "id", "left_semi")
    # kept by id, so that what is found out about a document joins it without moving texts
    texts = bucketed(own.repartition(buckets_of(docs.sparkSession), "id").join(repeated, "id"), "id", "texts")
    dropped(places)

    def contexts(batch: list[dict]) -> pa.RecordBatch:
        found = [Doc(r["text"], r["places"], cover) for r in batch]
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([np.zeros(0, np.int64), *(d.key[d.first].view(np.int64) for d in found)])),
            pa.array(np.concatenate([np.zeros(0, np.int64), *(d.context[d.first].view(np.int64) for d in found)])),
            pa.array(np.repeat(np.array([r["id"] for r in batch], np.int64), [int(d.first.sum()) for d in found])),
        ], ["key", "context", "id"])

    told = _per_doc(texts, ["id", "text", "places"], contexts, "key long, context long, id long")
    ranks = stored(told.groupBy("key", "context").agg(F.min("id").alias("id")), "ranks")
    forked = ranks.groupBy("key").agg(F.min("context").alias("low"), F.max("context").alias("high")).filter("low != high").select(
        "key", F.lit(True).alias("fork"))
    leads = stored(ranks.join(forked, "key", "left").groupBy("id").agg(
        F.collect_list("context").alias("leads"), F.collect_list(F.when(F.col("fork"), F.col("context"))).alias("forks")), "leads")
    dropped(ranks)
    known = texts.join(leads, "id", "left")

    def strings(batch: list[dict]) -> pa.RecordBatch:
        found = [np.unique(Doc(r["text"], r["places"], cover).open_strings(r["leads"], r["forks"])[1]) for r in batch]
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)),
            pa.array(np.repeat(np.array([r["id"] for r in batch], np.int64), [len(f) for f in found]))], ["string", "id"])

    asked = _per_doc(known.filter(F.size("forks") > 0), ["id", "text", "places", "leads", "forks"], strings, "string long, id long")
    firsts = asked.groupBy("string").agg(F.min("id").alias("id")).groupBy("id").agg(F.collect_list("string").alias("own"))
    firsts = stored(firsts, "firsts")

    def removed(batch: list[dict]) -> pa.RecordBatch:
        out = [_removed(r, cover) for r in batch]
        return pa.RecordBatch.from_arrays([
            pa.array([r["id"] for r in batch], pa.int64()), pa.array([r["sha"] for r in batch], pa.string()),
            pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], _SPANS)], ["id", "sha", "kept", "spans"])

    judged = known.join(firsts, "id", "left").withColumn("sha", F.sha2("text", 256))
    done = _per_doc(judged, ["id", "text", "places", "leads", "forks", "own", "sha"], removed,
                    "id long, sha string, kept string, spans array<struct<start:long,end:long>>")
    done = stored(done.dropDuplicates(["id", "sha"]), "removed")

    none = F.array().cast("array<struct<start:long,end:long>>")
    copy = (F.col("id") != F.col("leader")) & (F.col("n_bytes") >= length)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    spans = F.when(F.coalesce(copy, F.lit(False)), whole).otherwise(F.coalesce("spans", none))
    kept = F.when(F.coalesce(copy, F.lit(False)), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha"))
    out = marked.join(done, ["id", "sha"], "left").select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", kept.alias("kept_sha256"), spans.alias("spans"))
    cut = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select(id_col, "n_bytes", cut.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "spans")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _removed(row: dict, cover: Cover) -> tuple[str, list[dict]]:
    """Digest of what is left of a text, and its removed runs."""
    doc = Doc(row["text"], row["places"], cover)
    repeats = doc.settled(row["leads"])
    at, hashes = doc.open_strings(row["leads"], row["forks"])
    repeats[at[~(_firsts(hashes) & np.isin(hashes, _uint(row["own"])))]] = True
    start = np.flatnonzero(repeats)
    change = np.zeros(len(doc.raw) + 1, np.int32)
    np.add.at(change, start, 1)
    np.add.at(change, start + cover.length, -1)
    gone = np.cumsum(change)[:-1] > 0
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    spans = [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
    return hashlib.sha256(doc.raw[~gone].tobytes()).hexdigest(), spans
