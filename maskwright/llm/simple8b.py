"""Token ids in Simple-8b words, kept in files in ascending order of document.

The code.  A 64-bit word has a selector in its top 4 bits and as many ids as the
selector says in the 60 bits below, the first id lowest.  The encoder takes, from
where it stands, the selector that packs the most ids.  A value of 60 bits or more
is an escape: a word of selector 0 whose payload is the value's place in the block's
list of escapes.  The last word may name more ids than are left; the block's count says
where they end.

A block holds whole documents, about ``BLOCK_IDS`` ids (a longer document has a
block to itself).  Its bytes, little-endian::

    "S8B1" | version u32 | documents u64 | ids u64 | words u64 | escapes u64
    ids of each document                     u64 x documents
    id place of every STRIDE-th word         u64 x ceil(words / STRIDE)
    words                                    u64 x words
    escapes                                  u64 x escapes

A decoder expands all words of one selector at a time with array operations, and
from the places of every STRIDE-th word it can start in the middle of a block.

Files are rows (shard, block, first_id, n_ids, doc_ids, payload) of a Parquet
folder, written by Spark's committer: an executor lost while writing leaves no
half block behind, and readers need no file system but Spark's.  Shards are ranges of
document ids in order, blocks count from 0 in a shard, ``first_id`` is the
number of ids before the block in its shard.  An id that many rows have (a null, say) is several
shards, by a hash of the text.

Nulls: a null text has no ids but the end id; a null document id sorts first and is
kept.  Ties: documents of equal ids are in the order of a hash of their texts.  Repeated documents are kept, each with its own
ids.  Texts of any length are encoded whole.  Empty tables give an empty folder.  Other columns, whatever their names, are
neither read nor kept.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

#: Fixed by the code: for selectors 2 to 15, how many ids of how many bits.
PACKINGS = {2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6), 8: (8, 7), 9: (7, 8), 10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60)}
ESCAPE = 0
#: Selector 1: 120 zeros.
ZEROS = 1
STRIDE = 1024
BLOCK_IDS = 1 << 16
MAGIC = b"S8B1"
HEAD = struct.Struct("<4sIQQQQ")

_COUNTS = np.array([1, 120] + [PACKINGS[s][0] for s in range(2, 16)], dtype=np.int64)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) for unsigned ids."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return ids, ids
    big = np.flatnonzero(ids >> np.uint64(60))
    # the longest choice at every place: selectors from few ids to many, the later overwrite
    choice = np.full(n, 15, dtype=np.int8)
    top = int(ids.max())
    small = ids.astype(np.uint32) if top < 1 << 32 else ids
    fit = None  # places whose ids fit the selector; each selector's are among those of the one before
    for s in range(14, 0, -1):
        count, bits = PACKINGS.get(s, (120, 0))
        if not top >> bits:
            choice[:] = s
            continue
        fit = np.flatnonzero(small < 1 << bits) if fit is None else fit[small[fit] < 1 << bits]
        if not len(fit):
            break
        # runs of neighbours; past the end there is room for all that a word can name
        edge = np.flatnonzero(np.diff(fit) != 1) + 1
        first = np.concatenate([[0], edge])
        length = np.diff(np.concatenate([first, [len(fit)]]))
        room = length - count + 1
        if fit[-1] == n - 1:
            room[-1] = length[-1]
        at = room > 0
        first, room = fit[first[at]], room[at]
        if len(first):
            choice[np.repeat(first - (np.cumsum(room) - room), room) + np.arange(room.sum())] = s
    choice[big] = ESCAPE
    step = _COUNTS[choice].astype(np.uint8).tobytes()
    at, starts = 0, []
    add = starts.append
    while at < n:
        add(at)
        at += step[at]
    first = np.array(starts, dtype=np.int64)
    sel = choice[first]
    words = sel.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(120, dtype=np.uint64)])
    for s in np.unique(sel):
        if s in (ESCAPE, ZEROS):
            continue
        count, bits = PACKINGS[int(s)]
        rows = np.flatnonzero(sel == s)
        total = np.zeros(len(rows), dtype=np.uint64)
        for k in range(count):
            total |= padded[first[rows] + k] << np.uint64(k * bits)
        words[rows] |= total
    escaped = np.flatnonzero(sel == ESCAPE)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    return words, ids[first[escaped]]


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a run of words."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[sel]
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=np.uint64)
    for s in np.unique(sel):
        if s == ZEROS:
            continue
        rows = np.flatnonzero(sel == s)
        if s == ESCAPE:
            out[first[rows]] = escapes[(words[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        count, bits = PACKINGS[int(s)]
        mask = np.uint64((1 << bits) - 1)
        for k in range(count):
            out[first[rows] + k] = (words[rows] >> np.uint64(k * bits)) & mask
    return out[:n]


def pack_block(documents: list[np.ndarray]) -> bytes:
    ids = np.concatenate(documents) if documents else np.zeros(0, dtype=np.uint64)
    words, escapes = pack(ids)
    counts = _COUNTS[(words >> np.uint64(60)).astype(np.int64)]
    places = (np.cumsum(counts) - counts)[::STRIDE]
    return b"".join(
        [
            HEAD.pack(MAGIC, 1, len(documents), len(ids), len(words), len(escapes)),
            np.array([len(d) for d in documents], dtype="<u8").tobytes(),
            places.astype("<u8").tobytes(),
            words.astype("<u8").tobytes(),
            escapes.astype("<u8").tobytes(),
        ]
    )


class Block:
    """Reads a block's bytes; ``ids()`` decodes all of it, ``document(i)`` one document's words alone."""

    def __init__(self, data: bytes) -> None:
        magic, version, docs, self.n_ids, n_words, n_escapes = HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a Simple-8b block")
        at = HEAD.size
        parts = []
        for n in (docs, -(-n_words // STRIDE), n_words, n_escapes):
            parts.append(np.frombuffer(data, dtype="<u8", count=n, offset=at))
            at += 8 * n
        self.lengths, self.places, self.words, self.escapes = parts
        if at != len(data):
            raise ValueError("a Simple-8b block of the wrong length")

    def ids(self) -> np.ndarray:
        return unpack(self.words, self.escapes, self.n_ids)

    def document(self, i: int) -> np.ndarray:
        start = int(self.lengths[:i].sum())
        end = start + int(self.lengths[i])
        lo = max(int(np.searchsorted(self.places, start, side="right")) - 1, 0)
        hi = int(np.searchsorted(self.places, end, side="left"))
        words = self.words[lo * STRIDE : hi * STRIDE]
        base = int(self.places[lo]) if len(self.places) else 0
        return unpack(words, self.escapes, end - base)[start - base :]


#: Bytes of text that are encoded at once: the more, the fewer words are met again in the next ones.
GATHER_BYTES = 14 << 20
#: Shards per shuffle partition.
SHARDS = 4


def _narrow(data: bytes) -> bytes:
    """Ids as little-endian unsigned 16-bit integers where all fit, else as 32-bit ones; the first byte is the width."""
    ids = np.frombuffer(data, dtype="<u4")
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\x04" + data


def _narrowed(documents: pa.LargeBinaryArray) -> pa.Array:
    """``_narrow`` of every document of an array without nulls, from a first offset of 0."""
    _, edge, data = documents.buffers()
    edge = np.frombuffer(edge, np.int64, len(documents) + 1) // 4
    ids = np.frombuffer(data, "<u4", edge[-1]) if edge[-1] else np.zeros(0, "<u4")
    if len(ids) and ids.max() >= 1 << 16:
        return pa.array(list(map(_narrow, documents.to_pylist())), pa.large_binary())
    # all widths are 2: a byte before each document
    body = np.insert(ids.astype("<u2").view(np.uint8), 2 * edge[:-1], 2)
    edge = 2 * edge + np.arange(len(edge))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(documents), [None, pa.py_buffer(edge), pa.py_buffer(body)])


def _widened(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2" if data[0] == 2 else "<u4", offset=1)


def write_ids(docs: DataFrame, path: str, vocab: str, text: str = "text", id_col: str = "doc_id", end: int | None = tokens.END_ID) -> None:
    """Encode every whole text and write the files to the folder ``path``.

    Texts are encoded where they are read; their ids alone are shuffled, once, into ranges of document ids, where
    packing and writing follow in the same task, a block at a time.
    """
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.word_encoder(vocab)
        for batch in common.gathered(batches, "text", GATHER_BYTES):
            for part in common.slices(batch, "text", GATHER_BYTES):
                ids = _narrowed(encoder.encode_array(part.column(2), end)).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), ids], names=["id", "hash", "ids"])
        common.release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        names: list[int | None] = []
        size = block = first = shard = 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([first], pa.int64()), pa.array([size], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([pack_block(held)], pa.binary())],
                names=["shard", "block", "first_id", "n_ids", "doc_ids", "payload"],
            )

        for batch in batches:
            for own, name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids = _widened(data.as_py())
                if held and (own != shard or size + len(ids) > BLOCK_IDS):
                    yield done()
                    block, first, size, held, names = block + 1, first + size, 0, [], []
                if own != shard:
                    shard, block, first = own, 0, 0
                held.append(ids)
                names.append(name)
                size += len(ids)
        if held:
            yield done()

    key = F.coalesce(common.column(id_col).cast("long"), F.lit(common.FIRST_KEY))
    cuts = common.key_cuts(docs.select(key.alias("key")), SHARDS * common.shuffle_partitions(spark))
    body = common.column(text).cast("string")
    rows = docs.select(common.column(id_col).cast("long").alias("id"), F.xxhash64(body).alias("hash"), body.alias("text"))
    encoded = rows.mapInArrow(encode, "id long, hash long, ids binary").withColumn("key", F.coalesce("id", F.lit(common.FIRST_KEY)))
    dealt = encoded.withColumn("shard", common.range_of(cuts, "key", "hash")).repartition(common.shuffle_partitions(spark), "shard")
    files = dealt.sortWithinPartitions("shard", "key", "hash").select("shard", "id", "ids").mapInArrow(run, "shard int, block long, first_id long, n_ids long, doc_ids array<long>, payload binary")
    files.write.option("compression", "uncompressed").parquet(path)


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of every document in the files.

    ``start`` counts the ids of all documents before it.  The ids of a shard are
    summed per shard, so what is numbered in one place is a row per shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, first, names, payload = (batch.column(c)[i].as_py() for c in range(4))
                block = Block(payload)
                ids = block.ids().astype("<u4")
                ends = np.cumsum(block.lengths.astype(np.int64))
                starts = ends - block.lengths.astype(np.int64)
                cols = [
                    pa.array(names, pa.int64()),
                    pa.array([shard] * len(names), pa.int32()),
                    pa.array(starts + first, pa.int64()),
                    pa.array(ends - starts, pa.int64()),
                    pa.array([zlib.crc32(ids[s:e]) for s, e in zip(starts, ends)], pa.int64()),
                ]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]), pa.int32()), pa.array(ids, pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=fields)

    fields = ["__id", "shard", "at", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    files = spark.read.parquet(path)
    sums = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).coalesce(1)
    before = sums.selectExpr("shard", "coalesce(sum(n) over (order by shard rows between unbounded preceding and 1 preceding), 0) as before")
    docs = files.select("shard", "first_id", "doc_ids", "payload").mapInArrow(run, "__id long, shard int, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    return docs.join(before, "shard").select(F.col("__id").alias(id_col), (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
