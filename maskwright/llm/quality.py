"""Quality rules: a log-likelihood ratio of hashed n-grams between trusted and raw text.

Features are all runs of ``GRAM`` bytes of a text, hashed into ``BUCKETS`` buckets; runs of
bytes generalise from few trusted documents, where invented words do not.  The raw
multinomial is counted over all documents.  The target's is counted over trusted documents:
those that the labels call good, at most about ``TRUSTED`` of them, chosen by hash.  Every bucket's
target count is smoothed by ``PRIOR`` counts towards what the raw corpus lets expect, so a
bucket that was hardly seen says nothing.

A document's score is the mean over its features of log(target / raw).  Every document is
kept whose score is at least ``THRESHOLD``, none is drawn by chance.  Text like the trusted
documents scores about 0 or above; text whose runs of bytes the trusted documents lack, far below.

Before the ratio come plain rules: under ``LEAST_WORDS`` words, or over ``REPEATED_PERCENT``
percent of the words in 5-word windows that the text has twice, fail a document.

Nulls: a null or blank text has no word and fails.  A null id is no trusted
document.  Equal rows get equal results.  An empty table gives an empty result; without any
trusted document the ratio is 0 and only the rules decide.  Other columns pass through.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 16
#: Trusted documents that the target is counted over, about.
TRUSTED = 20_000
#: Counts that smooth a bucket.
PRIOR = 10.0
THRESHOLD = -0.22
#: Bytes of a feature.
GRAM = 3
LEAST_WORDS = 10
REPEATED_PERCENT = 20
WINDOW = 5
#: Fixed by the rule: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return h ^ (h >> np.uint64(32))


def features(text: str | None) -> np.ndarray:
    """Bucket numbers of all runs of ``GRAM`` bytes."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = len(data) - GRAM + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint16)
    runs = data[:n].astype(np.uint64)
    for k in range(1, GRAM):
        runs |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return ((runs * _MIX[0]) >> np.uint64(48)).astype(np.uint16)


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words that occurs twice or more.

    Hashes of windows find the candidates; candidates are compared word by word.
    """
    n = len(words) - size + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        mixed = mixed * _MIX[0] + hashes[k : k + n]
    mixed = _mixed(mixed)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    at = np.unique(np.concatenate([order[1:][same], order[:-1][same]])).tolist()
    counts = Counter(tuple(words[i : i + size]) for i in at)
    inside = np.zeros(len(words) + 1, dtype=np.int64)
    for i in at:
        if counts[tuple(words[i : i + size])] > 1:
            inside[i] += 1
            inside[i + size] -= 1
    return int((np.cumsum(inside) > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(common.BLANKS)]
    return len(lines) - len(set(lines))


def base_rules(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    words = common.words_of(text)
    word_chars = len(text) - sum(map(text.count, common.BLANKS))
    again = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * again > REPEATED_PERCENT * len(words)
    return len(words), word_chars, sum(map(text.count, SYMBOLS)), repeated_lines(text), again, failed


def count_features(docs: DataFrame, trusted: str, text: str) -> DataFrame:
    """(bucket, raw, target) summed over all documents; ``trusted`` is a boolean column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for flag, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.bincount(features(t.as_py()), minlength=BUCKETS)
                raw += own
                if flag:
                    target += own
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    rows = docs.select(F.col(trusted).alias("__trusted"), F.col(text).alias("__text"))
    return rows.mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def ratios(raw: np.ndarray, target: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log(target / raw) per bucket, the target's counts smoothed; 0 where nothing was counted."""
    if not raw.sum() or not target.sum():
        return np.zeros(len(raw))
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + prior) / (expected + prior))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", quality: str = "quality", trusted: int = TRUSTED) -> np.ndarray:
    """The table of ratios: one pass over all documents, ``BUCKETS`` numbers come back."""
    good = labels.where((F.col(quality) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("__id")).distinct()
    n = good.count()
    share = min(1.0, trusted / n) if n else 0.0
    chosen = good.where(F.xxhash64("__id") <= F.lit(common.hash_share(share))).withColumn("__good", F.lit(True))
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text).alias("__text"))
    # about ``trusted`` ids whatever the labels' size: small enough to broadcast
    marked = rows.join(F.broadcast(chosen), "__id", "left").select(F.coalesce("__good", F.lit(False)).alias("__good"), "__text")
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, r, t in count_features(marked, "__good", "__text").toLocalIterator():
        raw[b], target[b] = r, t
    return ratios(raw, target).astype(np.float32)


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, kept boolean"


def judge(docs: DataFrame, table: np.ndarray, text: str = "text", out: str = "judged", threshold: float = THRESHOLD) -> DataFrame:
    """Add the struct ``out`` with ``FIELDS``."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def one(text_: str | None) -> tuple:
        base = base_rules(text_)
        found = features(text_)
        mean = float(shared.value[found].mean(dtype=np.float64)) if len(found) else 0.0
        return *base, mean, not base[-1] and mean >= threshold

    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]

    @F.arrow_udf(FIELDS)
    def judged(col: pa.Array) -> pa.Array:
        found = list(zip(*(one(t.as_py()) for t in col))) or [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(f, k) for f, k in zip(found, kinds)], names=names)

    return docs.withColumn(out, judged(F.col(text)))
