"""SimHash near-duplicates found with tables of distances to pivots.

A fingerprint is 64 bits: bit b is set when over half of the document's word
shingles (repeats included) have bit b set in their XXH64 (seed 42).  Two
fingerprints link when at most ``max_bits`` bits differ, and a component is what
links reach.

How links are found, exactly and without comparing everything with everything:

1. Equal fingerprints are collapsed first, with partial sums, so thousands of
   copies count once.
2. The table of distances.  The pivots (reference fingerprints) are the one
   without ones, one for each of 32 cells of two bits, whose ones are that cell,
   and 31 far from one another.  Half of the distance to the first less that to a
   cell's pivot, plus one, is a coordinate of 0, 1 or 2 that depends on
   the bits of that cell alone, so a differing bit moves one coordinate of the 32.
3. Files.  The coordinates are cut into B bands.  Fingerprints that differ in r
   bits have all coordinates equal in B - r bands at least, so each one is filed under
   its coordinates in every choice of B - r bands.  B grows with the number of
   fingerprints, which keeps a file short whatever the corpus's size; the members of a
   file that is longer than ``file_limit`` all the same are filed again in finer bands.
4. In a file, two fingerprints whose distances to any pivot differ by more than r
   cannot link (triangle inequality): such pairs go by the maximum difference of
   their coordinates.  What is left is verified by the real distance.  Every file is compared whole.

``deduplicated`` adds a second kind of link.  Few changed words already turn more than two bits, so texts that
share at least ``SIMILAR`` of their five-word shingles are linked too.  Texts are filed under their first shingles in an order
with rare ones first, so many of them that similar texts share one; every pair of a file that lengths, places and
counts do not rule out, and that no other link joins, is decided by all shingles of both whole texts.  No pair is lost.

Nulls and blanks: a null or blank text has no shingle, its fingerprint is zero,
and it links like any other.  A text with fewer words than a shingle has one
shingle, its whole sequence.  Rows with the same id and text stay rows of their own;
a null id takes part, but is nobody's smallest id unless all ids of its
component are null; of equal smallest ids (ties) either may stand for the group, as rows of one id and hash are equal.  Texts are
read whole, whatever their length.  An empty table gives an empty result.  ``classes`` neither reads nor returns other
columns of the input; ``deduplicated`` returns them as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
#: Bits of a cell, and pivots besides the first and those of cells: 64 in all, the width of the distance table.
CELL, FAR_PIVOTS = 2, 31
CELLS = 64 // CELL
#: Files of more members are filed again in ``FINE`` bands.
FILE_LIMIT = 1024
FINE = 16
#: Rows of a file that are compared at once.
COMPARE_ROWS = 1 << 16

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def shingles(words: list[bytes], size: int) -> list[bytes]:
    if not words:
        return []
    if len(words) < size:
        return [b" ".join(words)]
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def fingerprint(text: str | None, size: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text; ASCII letters count in lower case."""
    words = common.words_of(text)
    if not words:
        return 0
    words = b" ".join(words).lower().split()  # bytes.lower() changes A-Z alone
    hashes = np.fromiter(map(_hash, shingles(words, size)), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", size: int = 3) -> DataFrame:
    """(id, fp): ``fp`` is the fingerprint as a signed long, ``id`` the id column under its own name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["__id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text).alias("__text"))
    return rows.mapInArrow(run, "__id long, fp long").withColumnRenamed("__id", id_col)


def pivots() -> np.ndarray:
    """The reference fingerprints: the one without ones, the cells', and fixed ones far from one another."""
    cells = [((1 << CELL) - 1) << (CELL * i) for i in range(CELLS)]
    return np.array([0, *cells, *(xxhash.xxh64_intdigest(b"pivot %d" % i, seed=SEED) for i in range(FAR_PIVOTS))], dtype=np.uint64)


def distance_table(values: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Row j has the Hamming distance of every value to pivot j."""
    return np.stack([np.bitwise_count(values ^ r) for r in refs]).astype(np.int8)


def coordinates(table: np.ndarray) -> np.ndarray:
    """Per fingerprint the coordinates of its cells, ``CELL`` bits each, from its distances to the pivots."""
    out = np.zeros(table.shape[1], dtype=np.uint64)
    for i in range(CELLS):
        out |= ((table[0] - table[1 + i] + CELL) // 2).astype(np.uint64) << np.uint64(CELL * i)
    return out


def _left_by_pivots(table: np.ndarray, a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs (a, b) have no coordinate that differs by more than ``max_bits``."""
    at = np.arange(len(a))
    for row in table[::-1]:  # those far from one another tell most
        if not len(at):
            return at
        at = at[np.abs(row[a[at]] - row[b[at]]) <= max_bits]
    return at


def _close(table: np.ndarray, values: np.ndarray, a: np.ndarray, b: np.ndarray, max_bits: int) -> tuple[np.ndarray, int]:
    """(which pairs (a, b) link, how many pivots have left): pivots discard, the distance itself decides."""
    at = _left_by_pivots(table, a, b, max_bits)
    return at[np.bitwise_count(values[a[at]] ^ values[b[at]]) <= max_bits], len(at)


def _smallest_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For positions 0..n-1, the smallest position reachable over the pairs."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        rest = label[a] != label[b]
        a, b = a[rest], b[rest]
    while not np.array_equal(label, nxt := label[label]):
        label = nxt
    return label


def _links_in(keys: np.ndarray, values: np.ndarray, refs: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray, tuple[int, int, int]]:
    """Links that join all members of a file that reach one another, and (pairs, left by pivots, linked); rows come sorted by key."""
    n = len(keys)
    table = distance_table(values, refs)
    ends = np.searchsorted(keys, keys, side="right")
    found_a, found_b = [], []
    pairs = kept = 0
    shift, left = 1, np.flatnonzero(ends - np.arange(n) > 1)
    while len(left):
        close, few = _close(table, values, left, left + shift, max_bits)
        pairs, kept = pairs + len(left), kept + few
        found_a.append(left[close])
        found_b.append(left[close] + shift)
        shift += 1
        left = left[left + shift < ends[left]]
    if not found_a:
        return values[:0], values[:0], (0, 0, 0)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    label = _smallest_reached(n, a, b)
    moved = np.flatnonzero(label != np.arange(n))
    return values[moved], values[label[moved]], (pairs, kept, len(a))


def band_masks(bands: int, max_bits: int) -> list[int]:
    """One mask of coordinates for each choice of ``bands - max_bits`` of the bands, as signed longs."""
    edge = [CELLS * i // bands * CELL for i in range(bands + 1)]
    one = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(bands)]
    masks = [sum(c) for c in combinations(one, bands - max_bits)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def bands_for(count: int, max_bits: int) -> int:
    """As few bands as keep the mean file under 8 members for ``count`` spread-out fingerprints; a coordinate has 1.5 bits."""
    bands = max_bits + 1
    while bands < max_bits + 6 and count > 8 << (3 * CELLS * (bands - max_bits) // bands // 2):
        bands += 1
    return bands


def _filed_by_coordinates(distinct: DataFrame, masks: list[int]) -> DataFrame:
    """(c, m, fp, n): the files that have more than one member."""
    refs = pivots()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            placed = coordinates(distance_table(values.view(np.uint64), refs))
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(placed.view(np.int64))], names=["fp", "at"])

    keys = F.array(*(F.struct(F.lit(i).cast("long").alias("c"), F.col("at").bitwiseAND(F.lit(m)).alias("m")) for i, m in enumerate(masks)))
    filed = distinct.select("fp").mapInArrow(run, "fp long, at long").select("fp", F.explode(keys).alias("k")).select("k.c", "k.m", "fp")
    sizes = filed.groupBy("c", "m").agg(F.count("*").alias("n")).where("n > 1")
    return common.stored(filed.join(sizes, ["c", "m"]), "simhash-files")


def _compared(files: DataFrame, max_bits: int, report: bool = False) -> DataFrame:
    """(a, b): links within files; or with ``report`` (pairs, kept, linked) of every run of files."""
    refs = pivots()

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def links_of(rows: np.ndarray) -> pa.RecordBatch:
            _, keys = np.unique(rows[:, :2], axis=0, return_inverse=True)
            order = np.argsort(keys, kind="stable")
            a, b, counts = _links_in(keys[order], rows[order, 2].view(np.uint64), refs, max_bits)
            if report:
                return pa.RecordBatch.from_arrays([pa.array([c], pa.int64()) for c in counts], names=["pairs", "kept", "linked"])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1))
            size += batch.num_rows
            if size < COMPARE_ROWS or (held[0][0, :2] == held[-1][-1, :2]).all():
                continue
            rows = np.concatenate(held)
            # the last file may go on in the next batch
            cut = int(np.flatnonzero((rows[:, :2] == rows[-1, :2]).all(axis=1))[0])
            yield links_of(np.ascontiguousarray(rows[:cut]))
            held, size = [rows[cut:]], len(rows) - cut
        if size:
            yield links_of(np.ascontiguousarray(np.concatenate(held)))

    dealt = files.select("c", "m", "fp").repartition(common.shuffle_partitions(files.sparkSession), "c", "m").sortWithinPartitions("c", "m")
    return dealt.mapInArrow(sweep, "pairs long, kept long, linked long" if report else "a long, b long")


def links(distinct: DataFrame, max_bits: int = 2, bands: int | None = None, file_limit: int = FILE_LIMIT, report: bool = False) -> DataFrame:
    """(a, b): links among the distinct longs of column ``fp`` that connect every component.

    With ``report`` instead (pairs, kept, linked): how many pairs the files have, how many of them the pivots leave and how many link.
    """
    if not 1 <= max_bits <= 2:
        raise ValueError("max_bits is 1 or 2")
    files = _filed_by_coordinates(distinct, band_masks(bands or bands_for(distinct.count(), max_bits), max_bits))
    found = _compared(files.where(F.col("n") <= file_limit), max_bits, report)
    dense = common.stored(files.where(F.col("n") > file_limit).select("fp").distinct(), "simhash-dense")
    if not dense.isEmpty():
        finer = _filed_by_coordinates(dense, band_masks(FINE, max_bits))
        found = found.union(_compared(finer, max_bits, report))
    return found if report else found.distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """(node, root): the smallest node that each node of an edge reaches, by alternating large and small stars.

    Every round is written to the shared folder, so no round is computed twice and
    a lost executor costs one round's tasks.  A hub is a key of joins with
    pre-aggregated sides, never a list in memory.
    """
    now = common.stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "components")
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        nxt = large.join(small, "u").select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).where("u <> v").union(small.select("u", F.col("m").alias("v"))).distinct()
        nxt = common.stored(nxt, "components")
        common.forget(now)
        now, before, mark = nxt, mark, _mark(nxt)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges: their number and two sums of hashes."""
    row = edges.select(F.xxhash64("u", "v").alias("h")).agg(F.count("*"), F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftright("h", 33))).first()
    return tuple(row)


def grouped(fps: DataFrame, max_bits: int = 2, more: Callable[[DataFrame], DataFrame] | None = None, **how: int) -> DataFrame:
    """(fp, root): the class of every distinct ``fp`` of a stored frame; classes are named by one of their fingerprints.

    ``more`` gets the links (a, b) and returns them and further ones.
    """
    distinct = common.stored(fps.select("fp").distinct(), "simhash-distinct")
    edges = links(distinct, max_bits, **how)
    linked = components(more(common.stored(edges, "simhash-near")) if more else edges).withColumnRenamed("node", "fp")
    return distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


# links of similar texts whose fingerprints differ in more than a few bits

#: Words of a shingle and share of common shingles from which texts count as similar.
SIMILAR_WORDS = 5
SIMILAR = 0.8
#: Texts from which common shingles are learned, about, and the shingles that are held as common, at most: both decide how much
#: work the search has, not what it finds.
COMMON_TEXTS = 8192
COMMON = 1 << 16
#: Pairs, or rows to drop, up to which they are broadcast rather than joined by a shuffle of the texts.
BROADCAST_ROWS = 250_000
#: 64-bit words of the sketches that are compared in files.
WORDS = 8
#: Files before a file of a text that are known there, so that pairs which met in one of them are not named again.
EARLIER = 4
#: Files in which a text is linked to neighbours before all pairs are looked at, and how far away they may be.
NEIGHBOURS, REACH = 2, 32

_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.int64(0xFFFFFFFF)


def shingle_hashes(text: str | None, size: int = SIMILAR_WORDS) -> np.ndarray:
    """The hashes of a text's distinct shingles, in order; ASCII letters count in lower case."""
    words = common.words_of(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    words = b" ".join(words).lower().split()
    one = np.fromiter(map(_hash, words), dtype=np.uint64, count=len(words))
    n = max(1, len(one) - size + 1)
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(min(size, len(one))):
        mixed = mixed * _MIX + one[k : k + n]
    mixed = (mixed ^ (mixed >> np.uint64(31))) * _MIX
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """The share of common shingles of two texts' hashes."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def odd_sketch(hashes: np.ndarray, bits: int | None = None) -> np.ndarray:
    """One bit per bucket, set where an odd number of the hashes fall, as 64-bit words; by default about as many bits as hashes.

    A hash that one of two sets has alone turns one bit at most, so sketches differ in no more bits than sets in hashes.
    """
    bits = bits or max(64, 1 << max(0, len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def least_difference(x: np.ndarray, y: np.ndarray) -> int:
    """So many hashes at least are in one of two sets alone, by their sketches; the longer one is folded first."""
    x, y = sorted((x, y), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())


def least_common(n: np.ndarray | int, m: np.ndarray | int, similar: float) -> np.ndarray | float:
    """So many shingles, less a rounding error, are common to similar texts of ``n`` and ``m`` shingles."""
    return (n + m) * (similar / (1 + similar)) - 1e-6


def prefix(hashes: np.ndarray, common_ones: np.ndarray, ranks: np.ndarray, similar: float) -> np.ndarray:
    """The first hashes in an order that is the same for all texts, rare ones first: similar texts share one of them.

    ``common_ones`` is sorted, and ``ranks`` has the place of each of them in the order.
    """
    n = len(hashes)
    if not n:
        return hashes
    length = n - int(np.ceil(similar * n - 1e-6)) + 1
    if len(common_ones):
        at = np.minimum(np.searchsorted(common_ones, hashes), len(common_ones) - 1)
        hashes = hashes[np.lexsort((hashes, np.where(common_ones[at] == hashes, ranks[at], -1)))]
    return hashes[:length]


def pairs_in(keys: np.ndarray, place: np.ndarray, group: np.ndarray, sketches: np.ndarray, earlier: np.ndarray, similar: float, reach: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a file's members of different groups that may be similar, as rows, and how far apart their sketches are; rows come sorted by key, then place.

    ``place`` has a text's number of shingles in its upper half and the shingle's place in the lower one.  A pair's
    first common shingle is the first for both: so many shingles as the shorter rest has can be common, and in that
    file a similar pair passes, as it does by its sketches (a row of words each).  ``earlier`` has files that a text is in at
    lower places: a pair that passes here and has one of them in common passed there.  ``reach`` is how far apart members of a pair may be.
    """
    n, at = place >> 32, place & _LOW
    ends = np.searchsorted(keys, keys, side="right")
    shift, left = 1, np.flatnonzero(ends - np.arange(len(keys)) > 1)
    while len(left) and (reach is None or shift <= reach):
        other = left + shift
        near = n[left] >= similar * n[other] - 1e-6
        left, other = left[near], other[near]  # members further on are no shorter
        least = least_common(n[left], n[other], similar)
        hit = np.flatnonzero((group[left] != group[other]) & (np.minimum(n[left] - at[left], n[other] - at[other]) >= least))
        a, b = left[hit], other[hit]
        apart = np.bitwise_count(sketches[a] ^ sketches[b]).sum(axis=1, dtype=np.int64)
        hit = apart <= n[a] + n[b] - 2 * least[hit]
        a, b, apart = a[hit], b[hit], apart[hit]
        new = ~(earlier[a][:, :, None] == earlier[b][:, None, :]).any(axis=(1, 2))
        if new.any():
            yield a[new], b[new], apart[new]
        shift += 1
        left = left[left + shift < ends[left]]


def _by_file(rows: DataFrame, columns: list[str], work, schema: str, more: list[str] = ()) -> DataFrame:
    """``work`` gets the longs of whole files, sorted by ``columns`` in turn, and ``more``, as the columns of an array."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(batch.num_columns)], axis=1))
            size += batch.num_rows
            if size < COMPARE_ROWS or held[0][0, 0] == held[-1][-1, 0]:
                continue
            ready = np.concatenate(held)
            # the last file may go on in the next batch
            cut = int(np.flatnonzero(ready[:, 0] == ready[-1, 0])[0])
            yield from work(ready[:cut])
            held, size = [ready[cut:]], len(ready) - cut
        if size:
            yield from work(np.concatenate(held))
        common.release()

    dealt = rows.select(*columns, *more).repartition(common.shuffle_partitions(rows.sparkSession), columns[0])
    return dealt.sortWithinPartitions(*columns).mapInArrow(sweep, schema)


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).astype(np.int64)) for c in columns], names=[c.split()[0] for c in schema.split(", ")])


def common_shingles(rows: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of about ``COMMON_TEXTS`` of the ``count`` rows (row, text) have, sorted, and their ranks by frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(t.as_py()).view(np.int64))], names=["shingle"])

    some = rows.where(F.xxhash64("row") <= common.hash_share(min(1.0, COMMON_TEXTS / max(1, count)))).select("text")
    counts = some.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "shingle").limit(COMMON)
    found = counts.collect()  # at most COMMON rows
    values = np.array([r["shingle"] for r in found], dtype=np.int64).view(np.uint64)
    ranks = np.arange(len(values))[::-1]
    order = np.argsort(values)
    return values[order], ranks[order].copy()


_FILE = "shingle long, place long, node long"


def filed(read: DataFrame) -> DataFrame:
    """(shingle, place, node): the files of the first shingles of ``read`` (node, n, prefix) that have more than one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, at = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True)
            firsts = [np.frombuffer(batch.column(2)[i].as_py(), dtype=np.int64) for i in at.tolist()]
            sizes = np.array(list(map(len, firsts)), dtype=np.int64)
            if not sizes.sum():
                continue
            own = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            n = batch.column(1).to_numpy(zero_copy_only=False)[at].astype(np.int64)
            yield _batch(_FILE, np.concatenate(firsts), np.repeat(n << 32, sizes) | own, np.repeat(node, sizes))

    def several(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        # a text that the table repeats is one member
        rows = rows[np.concatenate([[True], np.any(rows[1:] != rows[:-1], axis=1)])]
        same = rows[1:, 0] == rows[:-1, 0]
        kept = rows[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        if len(kept):
            yield _batch(_FILE, *kept.T)

    return common.stored(_by_file(read.select("node", "n", "prefix").mapInArrow(run, _FILE), ["shingle", "place", "node"], several, _FILE), "simhash-shingles")


_PAIR = "a long, b long"


def candidates(files: DataFrame, nodes: DataFrame, group: str, similar: float, reach: int | None = None, nearest: bool = False) -> DataFrame:
    """(a, b): pairs of nodes of different groups that may be similar, each once; with ``nearest`` few of each two groups, those of like sketches.

    ``nodes`` (node, the group, odd) has the sketch of each node; a pair leaves its file only if their sketches allow it.
    """
    sketch, earlier = [f"w{i}" for i in range(WORDS)], [f"e{i}" for i in range(EARLIER)]

    def least_of(found: np.ndarray) -> np.ndarray:
        """Each pair once, or one of each two groups; ``found`` has (a, b, their groups, how far apart) in columns."""
        if not nearest:
            return np.unique(found[:, :2], axis=0)
        low, high = np.minimum(found[:, 2], found[:, 3]), np.maximum(found[:, 2], found[:, 3])
        order = np.lexsort((found[:, 1], found[:, 0], found[:, 4], high, low))
        first = np.concatenate([[True], (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)])
        return found[order[first]]

    def work(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        node, group_of = rows[:, 2], rows[:, 3]
        sketches = np.ascontiguousarray(rows[:, 4 : 4 + WORDS]).view(np.uint64)  # of signed numbers, the bits of their amounts would count
        for a, b, apart in pairs_in(rows[:, 0], rows[:, 1], group_of, sketches, rows[:, 4 + WORDS :], similar, reach):
            a, b = np.where(node[a] < node[b], (a, b), (b, a))
            held.append(np.stack([node[a], node[b], group_of[a], group_of[b], apart] if nearest else [node[a], node[b]], axis=1))
            size += len(a)
            if size >= 1 << 20:
                held = [least_of(np.concatenate(held))]
                size = len(held[0])
                if size >= 1 << 19:
                    yield _batch(_PAIR, *held[0][:, :2].T)
                    held, size = [], 0
        if size:
            yield _batch(_PAIR, *least_of(np.concatenate(held))[:, :2].T)

    # a file that is not there is the text itself, which no other text has
    before = (f"coalesce(lag(shingle, {i + 1}) over (partition by node order by place, shingle), node) as {e}" for i, e in enumerate(earlier))
    rows = files.selectExpr("*", *before).join(nodes.select("node", F.col(group).alias("group"), *(F.col("odd")[i].alias(w) for i, w in enumerate(sketch))), "node")
    return _by_file(rows, ["shingle", "place", "node", "group"], work, _PAIR, sketch + earlier).distinct()


def _where_both(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, of_text: Callable[[str | None], bytes], decide: Callable[[bytes, bytes], bool], broadcast_rows: int) -> DataFrame:
    """The pairs (a, b) for which ``decide`` is true of what ``of_text`` makes of both texts.

    ``pairs`` is stored; ``nodes`` (node, row) says which of the ``rows`` (row, text) has a node's text.  Up to
    ``broadcast_rows`` pairs are broadcast, so that only their own texts' results are shuffled; more of them are joined.
    """
    hint = F.broadcast if pairs.count() <= broadcast_rows else lambda df: df
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"), "a", "b")
    asked = ends.select("node").distinct().join(nodes.select("node", "row"), "node")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([of_text(t.as_py()) for t in part.column(1)], pa.binary())], names=["node", "made"])
        common.release()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple = (None, None, None, b"")
        for batch in batches:
            found = []
            for a, b, node, made in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                made = made.as_py()
                # a row that the table repeats is there twice
                if before[:2] == (a, b) and before[2] != node and decide(before[3], made):
                    found.append((a, b))
                before = a, b, node, made
            yield _batch(_PAIR, *np.array(found, dtype=np.int64).reshape(-1, 2).T)
        common.release()

    texts = rows.join(hint(asked), "row").select("node", "text").mapInArrow(make, "node long, made binary")
    met = texts.join(hint(ends), "node").select("a", "b", "node", "made")
    dealt = met.repartition(common.shuffle_partitions(pairs.sparkSession), "a", "b").sortWithinPartitions("a", "b", "node")
    return dealt.mapInArrow(meet, _PAIR).distinct()


def verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, similar: float, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The pairs (a, b) whose texts share at least ``similar`` of all their shingles.

    Sketches of as many bits as shingles set pairs aside that cannot be similar; all shingles decide on the others.
    """

    def sketch(text: str | None) -> bytes:
        hashes = shingle_hashes(text)
        return len(hashes).to_bytes(8, "little") + odd_sketch(hashes).tobytes()

    def possible(x: bytes, y: bytes) -> bool:
        n, m = (int.from_bytes(v[:8], "little") for v in (x, y))
        apart = least_difference(*(np.frombuffer(v, dtype=np.uint64, offset=8) for v in (x, y)))
        return (n + m - apart) / 2 >= least_common(n, m, similar)

    def share(x: bytes, y: bytes) -> bool:
        return likeness(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)) >= similar

    pairs = common.stored(pairs, "simhash-pairs")
    left = common.stored(_where_both(pairs, nodes, rows, sketch, possible, broadcast_rows), "simhash-possible")
    found = common.stored(_where_both(left, nodes, rows, lambda t: shingle_hashes(t).tobytes(), share, broadcast_rows), "simhash-verified")
    common.forget(pairs)
    common.forget(left)
    return found


def similar_links(read: DataFrame, nodes: DataFrame, rows: DataFrame, near: DataFrame, similar: float = SIMILAR, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(a, b): links of fingerprints that join all texts which share at least ``similar`` of their shingles.

    ``read`` (node, n, prefix) has the first shingles of every text, ``nodes`` (node, row, fp, odd) one row per distinct set of
    shingles with its sketch, ``rows`` (row, text) the texts, ``near`` (a, b) other links of fingerprints.  Texts are filed under
    their first shingles, rare ones first, where any two similar texts meet.  Neighbours in a few files of each text are verified
    first, which joins groups of near copies by about as many pairs as they have members, then the nearest pairs of each two
    groups, so that a text that a large group has left out is not paired with all of it; then all pairs are that no link joins yet.
    """
    files = filed(read)
    fps = nodes.select("node", "fp")
    found: list[DataFrame] = []

    def of_fps(pairs: DataFrame) -> DataFrame:
        by = lambda name: fps.select(F.col("node").alias(name), F.col("fp").alias(f"fp_{name}"))
        return pairs.join(by("a"), "a").join(by("b"), "b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))

    def link(some: DataFrame, **how) -> None:
        linked = components(reduce(DataFrame.union, found, near)).withColumnRenamed("node", "fp")
        roots = nodes.select("node", "fp", "odd").join(linked, "fp", "left").select("node", F.coalesce("root", "fp").alias("root"), "odd")
        pairs = verified(candidates(some, roots, "root", similar, **how), nodes, rows, similar, broadcast_rows)
        found.append(common.stored(of_fps(pairs), "simhash-similar"))

    # few files of each text, those of its rarest shared shingles; a text has no more files than first shingles
    few = files.selectExpr("*", "row_number() over (partition by node order by place & 4294967295, shingle) as k").where(F.col("k") <= NEIGHBOURS).drop("k")
    link(few, reach=REACH)
    link(files, nearest=True)
    link(files)
    found = common.stored(reduce(DataFrame.union, found), "simhash-similar")
    common.forget(files)
    return found


def classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", size: int = 3, max_bits: int = 2, **how: int) -> DataFrame:
    """(id, fp, component_id): every row with the smallest id that its fingerprint reaches.

    The smallest id of a class comes from partial minima, and rows get it by a join in which
    the other side has one row per fingerprint, so a hot fingerprint can be split.
    """
    with common.scratch(docs.sparkSession) as kept:
        fps = common.stored(fingerprints(docs, text, id_col, size), "simhash")
        low = fps.groupBy("fp").agg(F.min(id_col).alias("low"))
        named = common.stored(low.join(grouped(fps, max_bits, **how), "fp"), "simhash-classes")
        kept += [fps, named]
    roots = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return fps.join(named.join(roots, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicated(docs: DataFrame, text: str = "text", id_col: str = "doc_id", size: int = 3, max_bits: int = 2, similar: float | None = SIMILAR, broadcast_rows: int = BROADCAST_ROWS, **how: int) -> DataFrame:
    """One row of each group: that of its smallest id, null ids last; of equal rows, one.

    Groups are joined by fingerprints that differ in at most ``max_bits`` bits, all of which are found, and unless
    ``similar`` is None by texts that share that much of their five-word shingles, all of which are found too.
    A row is known by its id and a hash of all its values, so ids need not be unique.  The texts are read once for
    fingerprints and first shingles, and those of candidate pairs again; what is shuffled of them are hashes.
    """
    with common.small_batches(docs.sparkSession), common.scratch(docs.sparkSession) as kept:
        return _deduplicated(kept, docs, text, id_col, size, max_bits, similar, broadcast_rows, **how)


def _deduplicated(stored: list[DataFrame], docs: DataFrame, text: str, id_col: str, size: int, max_bits: int, similar: float | None, broadcast_rows: int, **how: int) -> DataFrame:
    """What is returned reads ``docs`` and the two frames that are put into ``stored``, without Python."""
    spark = docs.sparkSession
    columns = [common.column(c) for c in docs.columns]
    row, key = F.xxhash64(*columns), F.coalesce(common.column(id_col).cast("long"), F.lit(-(2**63)))
    rows = docs.select(common.column(id_col).cast("long").alias("id"), row.alias("row"), common.column(text).cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(common_shingles(rows, docs.count()) if similar is not None else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", 4 << 20):
                texts = part.column(2).to_pylist()
                values = np.array([fingerprint(t, size) for t in texts], dtype=np.uint64)
                sets = [shingle_hashes(t) if similar is not None else values[:0] for t in texts]
                nodes = np.array([_hash(x.tobytes()) for x in sets], dtype=np.uint64)
                firsts = [prefix(x, *shared.value, similar).tobytes() if similar is not None else b"" for x in sets]
                odd = [odd_sketch(x, 64 * WORDS).view(np.int64).tolist() for x in sets]
                found = [pa.array(values.view(np.int64)), pa.array(nodes.view(np.int64)), pa.array(list(map(len, sets)), pa.int64()), pa.array(firsts, pa.binary()), pa.array(odd, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *found], names=["id", "row", "fp", "node", "n", "prefix", "odd"])
        common.release()

    read = common.stored(rows.mapInArrow(run, "id long, row long, fp long, node long, n long, prefix binary, odd array<long>"), "simhash-read")
    fps = common.stored(read.select("id", "row", "fp", "node", "n"), "simhash")
    more = None
    if similar is not None:
        some = fps.where("n > 0")
        own = read.where("n > 0").groupBy("node").agg(F.min(F.struct("row", "fp")).alias("s"), F.first("odd").alias("odd"))
        nodes = common.stored(own.select("node", "s.*", "odd"), "simhash-nodes")
        # equal sets of shingles may have several fingerprints
        equal = some.select("node", F.col("fp").alias("a")).distinct().join(nodes.select("node", F.col("fp").alias("b")), "node").where("a <> b").select("a", "b")

        def more(edges: DataFrame) -> DataFrame:
            near = edges.union(equal)
            return near.union(similar_links(read.where("n > 0"), nodes, rows.select("row", "text"), near, similar, broadcast_rows))

    classes_ = common.stored(grouped(fps.select("fp"), max_bits, more, **how), "simhash-groups")
    common.forget(read)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    low = fps.groupBy("fp").agg(F.min(order).alias("low"))
    roots = low.join(classes_, "fp").groupBy("root").agg(F.min("low").alias("low"))
    named = classes_.join(roots, "root").select("fp", F.col("low.id").alias("low_id"), F.col("low.row").alias("low_row"))
    gone = fps.join(named, "fp").where(~(F.col("id").eqNullSafe(F.col("low_id")) & (F.col("row") == F.col("low_row"))))
    dropped_row, dropped_id = common.free_names(docs, "row", "id")
    dropped = common.stored(gone.select(F.col("row").alias(dropped_row), F.coalesce("id", F.lit(-(2**63))).alias(dropped_id)).distinct(), "simhash-dropped")
    hint = F.broadcast if dropped.count() <= broadcast_rows else lambda df: df
    found = docs.join(hint(dropped), (row == F.col(dropped_row)) & (key == F.col(dropped_id)), "left_anti")
    # equal rows, if any, are all still there; a row that occurs once needs no comparison
    copies = common.stored(fps.groupBy("id", "row").agg(F.count("*").alias("n")).where("n > 1").select(F.col("row").alias(dropped_row)).distinct(), "simhash-copies")
    stored += [dropped, copies]
    if copies.isEmpty():
        return found
    again = found.join(copies, row == F.col(dropped_row), "left_semi")
    return found.join(copies, row == F.col(dropped_row), "left_anti").union(again.dropDuplicates())
