"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank file.

The pieces are the byte strings of the vocabulary, each byte written as one visible
character; a piece's score is its negative rank, so the best-scored merge is the
lowest rank; normalisation is the identity. Texts are cut by the pre-token pattern,
each pre-token is encoded by the model, and decoding is the inverse byte mapping.

Nulls are empty texts (no ids, empty decoding). Repeated rows give repeated rows.
Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from patchloom.llm.tools import held, portions

# Pieces remembered per Python worker; a table beyond that is emptied between portions.
REMEMBERED = 120_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def byte_letters() -> list[str]:
    """A visible character for each byte: printable Latin-1 stands for itself, the
    others follow from U+0100 on (the format of the vocabulary's published form)."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    letters = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: int | bytes | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised model: normal pieces in rank order (a piece's id is its rank),
    then the unknown piece, which 256 byte pieces leave without use."""
    letters = byte_letters()
    by_rank = {rank: piece for piece, rank in ranks.items()}
    if sorted(by_rank) != list(range(len(ranks))):
        raise ValueError("ranks must be 0 .. n-1 without gaps")
    out = []
    for rank in range(len(ranks)):
        name = "".join(letters[b] for b in by_rank[rank]).encode()
        out.append(_field(1, _field(1, name) + _field(2, float(-rank)) + _field(3, 1)))
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    bpe, absent = 2, (1 << 64) - 1
    trainer = _field(3, bpe) + _field(4, len(ranks) + 1) + _field(40, len(ranks))
    trainer += b"".join(_field(k, absent) for k in (41, 42, 43))
    identity = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, identity)


class Decoder:
    """The byte strings of a vocabulary by rank."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.pieces = [piece for piece, _ in sorted(self.ranks.items(), key=lambda x: x[1])]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


class Codec(Decoder):
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        super().__init__(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self.letters = byte_letters()
        self.split = regex.compile(pattern).findall
        self.joint = regex.compile(r" (?:\s|$)").search
        self.letter_of = {b: letter for b, letter in enumerate(self.letters)}
        self.known: dict[str, bytes] = {}  # ids packed as little-endian 32-bit integers
        self.spaced: dict[str, bytes] = {}

    def _learn(self, texts: set[str]) -> None:
        """Ids of pre-tokens not met before, in one call of the model."""
        new = []
        for text in texts:
            whole = self.ranks.get(text.encode())
            if whole is not None:
                self.known[text] = struct.pack("<I", whole)
            else:
                new.append(text)
        mapped = [t.encode().decode("latin-1").translate(self.letter_of) for t in new]
        for text, ids in zip(new, self.model.encode(mapped, num_threads=1) if new else []):
            self.known[text] = struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, each cut by the pattern."""
        cut = [self.split(t) for t in texts]
        self._learn(set(chain.from_iterable(cut)).difference(self.known))
        get = self.known.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text.

        A space before a visible character always begins a pre-token, so a text may be
        cut there and the pieces looked up; a text with other runs of white space is
        cut by the pattern alone."""
        for table in (self.known, self.spaced):
            if len(table) > REMEMBERED:
                table.clear()
        cut = [[] if self.joint(t) else t.split(" ") for t in texts]
        rest = set(chain.from_iterable(c[1:] for c in cut)).difference(self.spaced)
        self.spaced.update(zip(rest, self._whole([" " + t for t in rest])))
        heads = self._whole([c[0] if c else t for c, t in zip(cut, texts)])
        get = self.spaced.__getitem__
        return [b"".join(chain((head,), map(get, pieces[1:]))) for head, pieces in zip(heads, cut)]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], "<u4").tolist()


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process."""
    return held(("codec", path, pattern), lambda: Codec(path, pattern))


def decoder(path: str) -> Decoder:
    """Decoding needs no model."""
    return held(("pieces", path), lambda: Decoder(path))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>``; the vocabulary file must be readable on every worker."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in (part for b in batches for part in portions(b, 1)):
            rows = [np.frombuffer(ids, "<i4") for ids in own.encode_all([t or "" for t in batch.column(1).to_pylist()])]
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, n_tokens, packed binary, decoded binary``: ``packed`` holds the ids as
    little-endian unsigned 32-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(path)
        # few rows at a time: a row of ids decodes to about as many bytes as it has itself
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            lists = batch.column(1)
            if lists.null_count:
                lists = pa.array([r or [] for r in lists.to_pylist()], pa.list_(pa.int32()))
            flat, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            rows = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([len(r) for r in rows], pa.int64()),
                pa.array([r.tobytes() for r in rows], pa.binary()),
                pa.array([own.decode(r.tolist()) for r in rows], pa.binary()),
            ], [id_col, "n_tokens", "packed", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, packed binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256``: every text encoded, and its ids decoded
    again, in one pass, so that a worker holds one codec and no ids of another row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in (part for b in batches for part in portions(b, 1)):
            rows = []
            for ids in own.encode_all([t or "" for t in batch.column(1).to_pylist()]):
                decoded = own.decode(np.frombuffer(ids, "<u4").tolist())
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
