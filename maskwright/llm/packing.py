"""Minimum-bin-slack packing of token pieces into sequences.

Documents longer than a sequence are cut into pieces of the sequence's length; all
other documents stay whole.  What packing needs to know of the corpus is how many pieces
there are of each length, at most ``capacity`` numbers whatever the corpus's size, so
the plan is made on the driver from that table:

* a bin opens with the longest piece left;
* for the room that is left, a subset-sum dynamic programme over the available lengths,
  kept as bits of one integer, finds the fullest combination that fits;
* that combination is taken as often as the counts allow, and removed.

Each round uses up a length for its combination, so there are a few thousand
patterns at most (see ``plan``).  The pieces then find their places without meeting in
one task: within a length, pieces are numbered by salted row numbers plus the counts of
the salts before; the number selects the pattern, the sequence and the offset in it.
One length may hold any share of all pieces.

Nulls: a null text is its end id alone; a null id is packed like any other.  Repeated rows
are packed each.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 4096


def pieces(docs: DataFrame, vocab: str, capacity: int = CAPACITY, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.word_encoder(vocab)
        for batch in batches:
            for part in common.slices(batch, "__text"):
                rows = []
                for name, data in zip(part.column(0).to_pylist(), encoder.encode(part.column(1))):
                    for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                        own = data[at : at + 4 * capacity]
                        rows.append((name, piece, at // 4, len(own) // 4, zlib.crc32(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["__id", "piece", "start", "length", "ids_crc32"])
        common.release()

    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text).alias("__text"))
    return rows.mapInArrow(run, "__id long, piece int, start long, length long, ids_crc32 long").withColumnRenamed("__id", id_col)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the greatest sum up to ``room``.

    Bit s of ``sums`` says that sum s can be had; ``first`` keeps, per new sum, the
    step that made it, from which the combination is read back.  Longer lengths
    come first, and the search ends as soon as the room can be filled.
    """
    every = (1 << (room + 1)) - 1
    sums = 1
    steps: list[tuple[int, int]] = []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            grown = (sums | sums << length) & every
            if grown == sums:
                break
            steps.append((length, sums))
            sums = grown
            if sums >> room:
                break
        if sums >> room:
            break
    left, taken = sums.bit_length() - 1, {}
    for length, before in reversed(steps):
        if not before >> left & 1:
            taken[length] = taken.get(length, 0) + 1
            left -= length
    return taken


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: how many}) patterns that use up ``counts``.

    A pattern is taken as often as it fits the counts.  Afterwards one of its lengths has
    fewer pieces left than the pattern needs; a length that is needed k at a time has
    k - 1 left at most and is in log2(k) + 1 further patterns at most as the tightest one.
    """
    counts = {length: n for length, n in counts.items() if n}
    out = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        pattern = fullest({k: n for k, n in counts.items() if n}, capacity - longest)
        counts[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(counts[length] // n for length, n in pattern.items())
        out.append((times, pattern))
        for length, n in pattern.items():
            counts[length] -= times * n
            if not counts[length]:
                del counts[length]
    return out


def _places(patterns: list[tuple[int, dict[int, int]]], stride: int) -> dict[str, np.ndarray]:
    """One row per pattern, length and use of it: ranks ``first`` to ``first + times - 1`` of that length have it.

    ``key`` = length * stride + first orders the rows for a binary search.
    """
    used: dict[int, int] = {}
    rows = []
    base = 0
    for times, pattern in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            for _ in range(pattern[length]):
                rows.append((length * stride + used.get(length, 0), base, offset))
                used[length] = used.get(length, 0) + times
                offset += length
        base += times
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 3).T
    return dict(zip(("key", "base", "offset"), cols))


def pack(pieces_df: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces; ``pieces_df`` is read twice, so it is best stored."""
    counts = {int(r[0]): int(r[1]) for r in pieces_df.groupBy("length").count().collect()}  # at most ``capacity`` rows
    total = sum(counts.values())
    stride = total + 1
    places = pieces_df.sparkSession.sparkContext.broadcast(_places(plan(counts, capacity), stride))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = places.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "__number"))
            key = length * stride + rank
            at = np.searchsorted(p["key"], key, side="right") - 1
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p["base"][at] + key - p["key"][at], pa.int64()), pa.array(p["offset"][at], pa.int64())], names=names)

    rows = common.numbered(pieces_df, "length", [id_col, "piece", "ids_crc32"], "__number", total).select(id_col, "piece", "start", "length", "ids_crc32", "__number")
    names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return rows.mapInArrow(run, f"`{id_col}` long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocab: str, capacity: int = CAPACITY, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    return pack(common.stored(pieces(docs, vocab, capacity, text, id_col), "pieces"), capacity, id_col)
