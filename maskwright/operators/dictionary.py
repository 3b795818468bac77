"""The user dictionary: a table of terms, and matching it against blocks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import text as t
from maskwright.operators.order import numbered
from maskwright.schema import CANDIDATE, DICTIONARY, ENTITY_TYPES, MAX_NOTE, MAX_TERM, Conflict, InvalidInput, NotFound, struct_type

SOURCE = "pii-dictionary"
#: A dictionary of at most so many terms becomes part of the plan; a larger one is joined.
PLAN_TERMS = 200
#: Up to so many terms are sent to every row, which looks for each; filing texts under their runs costs as much as about so many searches.
SCAN_TERMS = 1_000
#: Up to so many terms of a join are broadcast, so that runs of text are not shuffled.
BROADCAST_TERMS = 200_000
#: Parts into which a run of characters that many texts have is dealt where terms are not broadcast.
SALTS = 16
#: Characters of a term that a join's key has.
KEY_LENGTH = 3


def now_utc() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def term_pattern(term: str) -> str:
    """A Java pattern for the term itself, any case."""
    quoted = re.sub("[ßẞ]", r"\\E[ßẞ]\\Q", term.replace("\\E", "\\E\\\\E\\Q"))  # Java does not fold these two
    return f"{t.PYTHON_FLAGS_ANY_CASE}\\Q{quoted}\\E"


def _candidates(spans: Column, entity_type: Column) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(entity_type.alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), F.lit(1.0).alias("score"), F.lit(SOURCE).alias("source")),
    ).cast(f"array<{CANDIDATE}>")


def match_terms(text: Column, terms: Iterable[tuple[str, str]]) -> Column:
    """Candidates of a small dictionary of (term, type), in its order; matches of a term do not overlap."""
    clean = t.unmarked(text)
    found = [_candidates(t.mark_spans(clean, term_pattern(term)), F.lit(entity)) for term, entity in terms if term]
    return F.concat(*found) if found else F.array().cast(f"array<{CANDIDATE}>")


def _one_for_one() -> tuple[str, str]:
    """Characters whose upper case has another lower case than their own, and that lower case."""
    pairs = [(chr(c), chr(c).upper().lower()) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000]
    kept = [(c, low) for c, low in pairs if len(low) == 1 == len(c.upper()) and low != c.lower()]
    return "".join(c for c, _ in kept), "".join(low for _, low in kept)


_SAME_UPPER = _one_for_one()


def folded(text: Column) -> Column:
    """Equal for texts that differ in case alone, character for character (what has no such fold is left)."""
    lower = F.lower(F.translate(text, "\u0130\u212aẞ", "ikß"))  # the one character whose lower case is two, and two others
    return F.translate(lower, *_SAME_UPPER)


#: A term with its place in the dictionary: ``key`` first, then ``seq``.
PAIR = "struct<key:string,seq:bigint,term:string,entity_type:string>"


def listed(dictionary: DataFrame) -> DataFrame:
    """(key, seq, term, entity_type) of a dictionary's rows (id, term, entity_type): in the order of ``Dictionary.list``."""
    return dictionary.where(F.length("term") > 0).select(t.ascii_key(F.col("term")).alias("key"), F.col("id").cast("long").alias("seq"), "term", "entity_type")


def _term_fold(pair: Column) -> Column:
    return folded(pair["term"])


def count_pairs(text: Column, pairs: Column, fold: Callable[[Column], Column] = _term_fold) -> Column:
    """array<struct<term,hits>> of the ``pairs`` that the text holds: how many candidates each has, counted without making them."""

    def hits(whole: Column, p: Column) -> Column:
        rest = F.replace(whole, fold(p), F.lit(""))
        return F.struct(p["term"].alias("term"), ((F.octet_length(whole) - F.octet_length(rest)) / F.octet_length(fold(p))).cast("long").alias("hits"))

    held = F.transform(F.array(folded(t.unmarked(text))), lambda f: F.transform(F.filter(pairs, lambda p: F.contains(f, fold(p))), lambda p: hits(f, p)))
    return F.element_at(held, 1)


def match_pairs(text: Column, pairs: Column, fold: Callable[[Column], Column] = _term_fold) -> Column:
    """Candidates for an array of ``PAIR``, in their order.  The pattern differs by row."""
    clean = t.unmarked(text)

    def one(p: Column) -> Column:
        inner = F.regexp_replace(F.replace(p["term"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), "[ßẞ]", r"\\E[ßẞ]\\Q")
        quoted = F.concat(F.lit(t.PYTHON_FLAGS_ANY_CASE + "\\Q"), inner, F.lit("\\E"))
        return _candidates(t.mark_spans(clean, quoted), p["entity_type"])

    # most files' terms are not in the block: a plain search settles that before a pattern is made
    lower = F.element_at(F.transform(F.array(folded(clean)), lambda f: F.filter(pairs, lambda p: F.contains(f, fold(p)))), 1)
    return F.flatten(F.transform(F.array_sort(lower), one))


def text_key(text: Column) -> Column:
    """The key of a text in ``join_terms``: texts that share one by chance get each other's terms too, which then match nothing."""
    return F.xxhash64(text)


def join_terms(blocks: DataFrame, text: str, terms: DataFrame, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(text_key, pairs): the terms whose first characters a text has, for a dictionary (``listed``) of any size.

    Texts are filed under their distinct runs of up to ``KEY_LENGTH`` folded characters, terms under
    their first ``KEY_LENGTH``, or all if they are shorter; an equal join then finds the few terms to look
    for in a text.  Up to ``broadcast_terms`` terms are broadcast, so runs meet them where they are made; more are joined by a
    shuffle, in which a frequent run's texts are dealt to ``SALTS`` parts.  Equal texts are filed as one.
    """
    filed = terms.select(F.struct("key", "seq", "term", "entity_type").cast(PAIR).alias("pair"), F.substring(folded(F.col("term")), 1, KEY_LENGTH).alias("run"))
    # all runs, by cutting the text into runs from each of the first places: no search by position
    cuts = [F.regexp_extract_all(F.substring(F.col("fold"), i + 1, 2**31 - 1), F.lit(f"(?s).{{{n}}}"), F.lit(0)) for n in range(1, KEY_LENGTH + 1) for i in range(n)]
    own = blocks.select(text_key(F.col(text)).alias("text_key"), folded(F.col(text)).alias("fold"))
    runs = own.select("text_key", F.explode_outer(F.array_distinct(F.concat(*cuts))).alias("run"))
    if filed.limit(broadcast_terms + 1).count() <= broadcast_terms:
        matched = runs.join(F.broadcast(filed), "run")
    else:
        salted = filed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        matched = runs.withColumn("salt", F.pmod("text_key", F.lit(SALTS)).cast("int")).join(salted, ["run", "salt"])
    return matched.groupBy("text_key").agg(F.collect_set("pair").alias("pairs"))


def with_pairs(rows: DataFrame, text: str, terms: DataFrame, out: str, key: str, scan_terms: int = SCAN_TERMS) -> DataFrame:
    """``rows`` and ``out``: an array of ``PAIR`` and ``fold``, the folded term, for a dictionary (``listed``) of any size.

    Up to ``scan_terms`` terms are all in every row's array, which is broadcast, and rows stay where they are; of more, a row has
    those that ``join_terms`` finds by ``key``, a free name.
    """
    with_fold = f"{PAIR[:-1]},fold:string>"
    if terms.limit(scan_terms + 1).count() <= scan_terms:
        listed_ = terms.agg(F.collect_list(F.struct("key", "seq", "term", "entity_type", folded(F.col("term")).alias("fold")).cast(with_fold)).alias(out))
        return rows.crossJoin(F.broadcast(listed_))
    found = join_terms(rows, text, terms).withColumnsRenamed({"text_key": key, "pairs": out})
    found = found.withColumn(out, F.transform(out, lambda p: F.struct(*(p[c].alias(c) for c in ("key", "seq", "term", "entity_type")), _term_fold(p).alias("fold")).cast(with_fold)))
    joined = rows.withColumn(key, text_key(F.col(text))).join(found, key, "left").drop(key)
    return joined.withColumn(out, F.coalesce(out, F.array().cast(f"array<{with_fold}>")))


class Dictionary:
    """Terms in a Parquet folder that any executor can reach.

    Writes go to a new version beside the old one, then the old version goes; there is one
    writer at a time.  Terms are compared without regard to the case of A-Z, per type.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path
        self._rows: list[tuple] = []
        if path:
            self._version = self._latest()

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root, root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _latest(self) -> str | None:
        jvm, root, fs = self._fs()
        if not fs.exists(root):
            return None
        done = [s.getPath() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max((p.toString() for p in done), default=None)

    def frame(self) -> DataFrame:
        """All terms, in no order; an empty table to begin with."""
        if self.path and self._version:
            return self.spark.read.schema(struct_type(DICTIONARY)).parquet(self._version)
        return self.spark.createDataFrame(self._rows, DICTIONARY)

    def list(self) -> DataFrame:
        """Terms in order, without regard to the case of A-Z."""
        return self.frame().orderBy(t.ascii_key(F.col("term")), "id")

    def _store(self, df: DataFrame) -> None:
        if not self.path:
            self._rows = [tuple(r) for r in df.select("id", "term", "entity_type", "note", "created_at").collect()]
            return
        number = int(self._version.rsplit("-", 2)[1]) + 1 if self._version else 0
        new = f"{self.path.rstrip('/')}/v-{number:012d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(new)
        old, self._version = self._version, new
        if old:
            jvm, _, fs = self._fs()
            fs.delete(jvm.org.apache.hadoop.fs.Path(old), True)

    def upsert(self, terms: DataFrame) -> DataFrame:
        """Add the (term, entity_type, note) rows that are new; returns all rows of the input with their entry and ``created``."""
        mine = trimmed(terms)
        bad = mine.where((F.length("term") < 1) | (F.length("term") > MAX_TERM) | (F.length("note") > MAX_NOTE)).limit(1).collect()
        if bad:
            raise InvalidInput(f"a term has 1 to {MAX_TERM} characters, a note up to {MAX_NOTE}")
        now = self.frame()
        last = now.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        new = new_entries(now, mine, last)
        if not new.isEmpty():
            # rows of the old version are read while the new one is written
            self._store(now.unionByName(new))
        stored = self.frame().withColumn("__key", t.ascii_key(F.col("term")))
        asked = mine.select(t.ascii_key(F.col("term")).alias("__key"), "entity_type").distinct()
        return stored.join(asked, ["__key", "entity_type"]).select("id", "term", "entity_type", "note", "created_at", (F.col("id") > last).alias("created"))

    def get_or_create(self, term: str, entity_type: str = "CUSTOM", note: str = "") -> tuple[dict, bool]:
        """(entry, whether it is new); the note of an entry that exists stays."""
        (row,) = self.upsert(self.spark.createDataFrame([(term, entity_type, note)], "term string, entity_type string, note string")).collect()
        entry = row.asDict()
        return entry, entry.pop("created")

    def create(self, term: str, entity_type: str = "CUSTOM", note: str = "") -> dict:
        entry, created = self.get_or_create(term, entity_type, note)
        if not created:
            raise Conflict("the term is in the dictionary")
        return entry

    def delete(self, entry_id: int) -> None:
        now = self.frame()
        if now.where(F.col("id") == entry_id).isEmpty():
            raise NotFound(f"no entry {entry_id}")
        self._store(now.where(F.col("id") != entry_id))


def trimmed(terms: DataFrame) -> DataFrame:
    note = F.col("note") if "note" in terms.columns else F.lit("")
    return terms.select(t.strip(F.col("term")).alias("term"), F.coalesce("entity_type", F.lit("CUSTOM")).alias("entity_type"), t.strip(F.coalesce(note, F.lit(""))).alias("note"))


def new_entries(now: DataFrame, terms: DataFrame, last_id: int) -> DataFrame:
    """Entries for trimmed terms that ``now`` lacks; of several with one key, the first by text."""
    keyed = terms.withColumn("__key", t.ascii_key(F.col("term"))).groupBy("__key", "entity_type").agg(F.min(F.struct("term", "note")).alias("f"))
    known = now.select(t.ascii_key(F.col("term")).alias("__key"), "entity_type")
    fresh = keyed.join(known, ["__key", "entity_type"], "left_anti")
    rows = numbered(fresh.select(F.col("f.term").alias("term"), "entity_type", F.col("f.note").alias("note")), ("term", "entity_type"))
    return rows.select((F.lit(last_id) + F.col("place")).cast("long").alias("id"), "term", "entity_type", "note", now_utc().alias("created_at"))


def check_type(entity_type: str) -> None:
    if entity_type not in ENTITY_TYPES:
        raise InvalidInput(f"unknown entity type {entity_type}")
