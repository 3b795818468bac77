"""Language identification by words first, then ever shorter character n-grams.

Training counts, per language, the lower-cased words of its texts and the character
n-grams (1 to ``MAX_GRAM``) of those words with a blank on either side.  The most frequent
``WORDS`` words and ``GRAMS`` n-grams of each length are kept, as natural logarithms of their
relative frequency; what a language lacks costs it a fixed penalty.

A word that any language knows is scored by the words' table.  Any other word falls back
to its n-grams of ``MAX_GRAM`` characters that any language knows, and their mean
is the word's score; if there is none, to n-grams one character shorter, and so on.  A
text's score per language is the mean over all its words.  The best language is
predicted (the first by name if two are equal).  ``score`` is its probability if the
mean stood for ``EVIDENCE`` independent words (fewer if the text has fewer).

The model is fitted on a bounded sample of labelled rows: about ``docs_per_lang`` texts
of each language, those of smallest hash of id and text, so hot languages do not
crowd out rare ones.  Its size is bounded over all languages: beyond ``FULL_LANGUAGES`` of them each has fewer words
and n-grams, down to ``LEAST_SHARE`` of them.

Nulls: a text that is null or has no letter gets ``und`` and score 0; a row of null
language or text is never learned from.  No labelled row at all: every text gets ``und``.
Ties: of equal means the first language by name wins; of equally frequent n-grams the first by text are kept.
Words of any length are one word and texts of any size are scored whole.  Repeated rows get equal results.  An empty
table gives an empty result.  Other columns pass through, but one that is named like the result (``out``) is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MAX_GRAM = 5
WORDS = 20_000
GRAMS = 8_000
#: Texts of each language that the model is fitted on.
DOCS_PER_LANG = 3_000
#: With more languages than this, fewer texts of each are learned from, but about ``LEAST_DOCS`` still.
LANGUAGES = 256
LEAST_DOCS = 50
#: Log frequency of what a language has not been seen to have.
PENALTY = -16.0
EVIDENCE = 8
UNDETERMINED = "und"
#: Words that a worker remembers the scores of.
REMEMBERED = 100_000
#: A longer word is scored anew each time.
LONGEST = 64
#: Up to so many languages each has all of its ``WORDS`` and ``GRAMS``, beyond it a part.
FULL_LANGUAGES = 16
LEAST_SHARE = 0.02

_letters = re.compile(r"[^\W\d_]+").findall


def words_in(text: str | None) -> list[str]:
    return _letters(text.lower()) if text else []


def grams_of(word: str, n: int) -> Iterator[str]:
    """n-grams of a word with a blank on either side; a blank by itself is none."""
    padded = f" {word} " if n > 1 else word
    return (padded[i : i + n] for i in range(len(padded) - n + 1))


class Model:
    """``tables[0]`` has the words, ``tables[n]`` the n-grams: text to its row of log frequencies, one per language."""

    def __init__(self, languages: list[str], tables: list[dict[str, int]], rows: np.ndarray) -> None:
        self.languages, self.tables, self.rows = languages, tables, rows

    @staticmethod
    def fit(counts: list[tuple[str, int, str, int, int]]) -> "Model":
        """From rows (language, n, text, count, all counts of that language and n)."""
        languages = sorted({r[0] for r in counts})
        place = {x: i for i, x in enumerate(languages)}
        tables: list[dict[str, int]] = [{} for _ in range(MAX_GRAM + 1)]
        rows = np.full((len(counts), len(languages)), PENALTY)
        used = 0
        for language, n, text, count, total in counts:
            at = tables[n].setdefault(text, used)
            used += at == used
            rows[at, place[language]] = max(PENALTY, np.log(count / total))
        return Model(languages, tables, rows[:used].copy())

    def word_scores(self, word: str) -> np.ndarray:
        found = self.tables[0].get(word)
        if found is not None:
            return self.rows[found]
        for n in range(MAX_GRAM, 0, -1):
            table = self.tables[n]
            at = Counter(r for g in grams_of(word, n) if (r := table.get(g)) is not None)
            if at:
                times = np.fromiter(at.values(), dtype=float, count=len(at))
                return times @ self.rows[list(at)] / times.sum()
        return np.full(len(self.languages), PENALTY)


class Scorer:
    """Applies a model and remembers the scores of words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.model.languages)))

    def _add(self, words: set[str]) -> None:
        for w in words:
            at = self.place[w] = len(self.place)
            if at == len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[at] = self.model.word_scores(w)

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_in(text)
        if not words or not self.model.languages:
            return UNDETERMINED, 0.0
        if not any(map(str.isalpha, words)) and not any(c.isalpha() for w in words for c in w):
            return UNDETERMINED, 0.0  # signs of numbers only, such as fractions
        if len(self.place) > REMEMBERED:
            self._clear()
        short = [w for w in words if len(w) <= LONGEST] if max(map(len, words)) > LONGEST else words
        self._add(set(short).difference(self.place))
        at = np.fromiter(map(self.place.__getitem__, short), dtype=np.int64, count=len(short))
        total = self.scores[at].sum(axis=0)
        if len(short) < len(words):
            total += sum(self.model.word_scores(w) for w in words if len(w) > LONGEST)
        mean = total / len(words)
        best = int(np.argmax(np.round(mean, 9)))
        return self.model.languages[best], float(1 / np.exp((mean - mean[best]) * min(EVIDENCE, len(words))).sum())


def sampled(docs: DataFrame, text: str, lang: str, id_col: str, docs_per_lang: int) -> DataFrame:
    """(lang, text): rows of smallest hash, about ``docs_per_lang`` of each language, or fewer if there are many languages.

    The hash's limit per language is a quantile from one aggregation; nothing is ranked
    in one task.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.col(text)).alias("h"))
    # hashes are spread evenly over all longs, so a share of them is a share of the rows
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row per language
    each = min(docs_per_lang, max(LEAST_DOCS, docs_per_lang * LANGUAGES / max(1, len(sizes))))
    limits = {r["lang"]: each / r["n"] for r in sizes if r["n"] > each}
    if not limits:
        return rows.select("lang", "text")
    limit = F.create_map(*(F.lit(x) for k, share in limits.items() for x in (k, common.hash_share(share))))
    return rows.where(F.coalesce(F.col("h") <= limit[F.col("lang")], F.lit(True))).select("lang", "text")


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", docs_per_lang: int = DOCS_PER_LANG) -> Model:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        common.model(None)
        for batch in batches:
            for language, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(language, Counter()).update(words_in(t))
        for language, own in words.items():
            for n in range(MAX_GRAM + 1):  # one length at a time: the n-grams of all would be many times the words
                counter = own if n == 0 else Counter()
                for w, k in own.items() if n else ():
                    for g in grams_of(w, n):
                        counter[g] += k
                keys = list(counter)
                for at in range(0, len(keys), 50_000):
                    part = keys[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([language] * len(part)), pa.array([n] * len(part), pa.int32()), pa.array(part), pa.array([counter[k] for k in part], pa.int64())], names=["lang", "n", "gram", "count"])
        common.release()

    sample = sampled(labelled, text, lang, id_col, docs_per_lang)
    counts = sample.mapInArrow(count, "lang string, n int, gram string, count long").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))
    kept = Window.partitionBy("lang", "n").orderBy(F.desc("count"), "gram")
    total = Window.partitionBy("lang", "n")
    ranked = counts.withColumn("total", F.sum("count").over(total)).withColumn("rank", F.row_number().over(kept))
    languages = max(1, sample.select("lang").distinct().count())
    share = max(LEAST_SHARE, min(1.0, FULL_LANGUAGES / languages))
    rows = ranked.where(F.col("rank") <= F.when(F.col("n") == 0, int(WORDS * share)).otherwise(int(GRAMS * share))).select("lang", "n", "gram", "count", "total")
    return Model.fit([tuple(r) for r in rows.collect()])  # FULL_LANGUAGES * (WORDS + MAX_GRAM * GRAMS) rows for up to 800 languages


def predict(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """Add the struct ``out`` (lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.tables, model.rows))

    @F.arrow_udf("lang_pred string, score double")
    def scored(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        common.model(None)
        scorer = Scorer(Model(*shared.value))
        for col in cols:
            found = [scorer.predict(t.as_py()) for t in col]
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["lang_pred", "score"])
        del scorer
        common.release()

    return docs.withColumn(out, scored(F.col(text)))


def held_out(id_col: str = "doc_id"):
    """True for ids whose crc32, of the id as text, leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
