"""Byte-level BPE by a sentencepiece model that is written straight from the ranks.

The model.  A rank file gives byte strings their ranks.  Each byte becomes one printable
character, so every byte string is a piece; a piece's score is its negative rank, so
the best-scored merge is the lowest-ranked one, as in byte-level BPE; normalisation is the
identity, no dummy prefix, no white space handling.  The model file is a protocol buffer of
a few field types, which is written here field by field; piece numbers are the ranks, the
required unknown piece comes last.

Encoding.  The split pattern cuts a text into pre-tokens, and each one is encoded by itself.
A worker keeps the ids of pre-tokens it has met, within a bound.  Decoding looks up the bytes
of each id and joins them.

Nulls: a null text is empty and has no ids.  Null ids, repeated rows and other columns pass
through as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import byte_characters

MULTI_BPE = "byte_bpe_multi_50k.tiktoken"
REMEMBERED = 150_000
#: Texts are split into pre-tokens, each an object, for about so many bytes at a time.
SLICE_BYTES = 8 << 20
LONGEST = 64

def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from a rank file's bytes: lines of a base64 string and a number."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer: bytes, a whole number or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


#: Fixed values of the model format: field numbers and types.
_PIECE, _TRAINER, _NORMALIZER = 1, 2, 3
_NORMAL, _UNKNOWN = 1, 2
_BPE = 2


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model for ranks that run from 0 without gaps."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    chars = byte_characters()
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = "".join(chars[b] for b in token).encode()
        out.append(_field(_PIECE, _field(1, piece) + _field(2, float(-rank)) + _field(3, _NORMAL)))
    out.append(_field(_PIECE, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, _UNKNOWN)))
    trainer = _field(3, _BPE) + _field(4, len(ranks) + 1) + _field(40, len(ranks))
    trainer += b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))  # no begin, end or padding piece
    normalizer = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(out) + _field(_TRAINER, trainer) + _field(_NORMALIZER, normalizer)


class ByteBpe:
    def __init__(self, rank_data: bytes, pattern: str) -> None:
        import sentencepiece

        ranks = read_ranks(rank_data)
        self.bytes_of = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.chars = {b: ord(c) for b, c in enumerate(byte_characters())}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode_new(self, pre_tokens: list[str]) -> list[bytes]:
        mapped = [t.encode().decode("latin-1").translate(self.chars) for t in pre_tokens]
        return [np.array(ids, dtype="<u4").tobytes() for ids in self.model.encode(mapped, num_threads=1)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        split = [self.split(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new, lengthy = [], {}
        for t in set().union(*split).difference(known):
            if (ids := older.get(t)) is not None:
                known[t] = ids
            else:
                new.append(t)
        for t, ids in zip(new, self._encode_new(new)):
            (known if len(t) <= LONGEST else lengthy)[t] = ids
        find = known.__getitem__ if not lengthy else (known | lengthy).__getitem__
        return [b"".join(map(find, s)) for s in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _read_model(path: str, pattern: str) -> ByteBpe:
    with open(path, "rb") as f:
        return ByteBpe(f.read(), pattern)


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """The worker's model for a rank file."""
    return common.model(_read_model, path, pattern)


def encode_column(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``: the ids of the whole text as an array of longs."""

    @F.arrow_udf("array<long>")
    def ids(col: pa.Array) -> pa.Array:
        data = byte_bpe(path, pattern).encode(col.to_pylist())
        ends = np.cumsum([0] + [len(d) // 4 for d in data])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(data), dtype="<u4").astype(np.int64)))

    return docs.withColumn(out, ids(F.col(text)))


def decode_column(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the bytes that the ids of a column stand for."""

    @F.arrow_udf("binary")
    def decoded(col: pa.Array) -> pa.Array:
        table = byte_bpe(path, pattern)
        return pa.array([table.decode(np.array(v, dtype="<u4").tobytes()) for v in col.to_pylist()], pa.binary())

    return df.withColumn(out, decoded(F.col(ids)))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode every whole text, decode the ids, and give digests of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_bpe(path, pattern)
        for batch in batches:
            for part in common.slices(batch, "__text", SLICE_BYTES):
                ids = model.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(model.decode(x)).hexdigest() for x in ids], pa.string()),
                    ],
                    names=["__id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text).alias("__text"))
    return rows.mapInArrow(run, "__id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("__id", id_col)
