"""The plan of an analysis: normalise, detect, resolve, project; and of what follows it."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import text as t
from maskwright.operators import detect, dictionary, mask, ner, resolve
from maskwright.schema import CANDIDATE, FINDING, MAX_TEXT

_OWN = ("__norm", "__tagged", "__key", "__pairs", "__found", "__chosen")


@dataclass(frozen=True)
class Engine:
    """``dictionary`` has (term, type) pairs, or is a DataFrame with id, term and entity_type.

    ``profile`` is that of the four structural patterns, ``tagger`` an optional model's loader.
    """

    entities: tuple[str, ...] | None = None
    dictionary: tuple[tuple[str, str], ...] | DataFrame = ()
    profile: str = "local"
    tagger: ner.Loader | None = None

    def info(self) -> dict[str, object]:
        return {"status": "ok", "nlp_available": ner.available(self.tagger), "local_only": True}

    def analyze(self, df: DataFrame, text: str = "text", block: str = "block_id", out: str = "findings", enabled: str | None = None, terms: str | None = None) -> DataFrame:
        """Add ``out``: the findings of each row's text, an array in order.

        ``block`` is the column that ids of findings are made of, and should tell rows apart.  ``enabled``
        is a column of types for each row; null or empty means the engine's own.  ``terms`` is a column of
        each row's own dictionary, an array of (term, entity_type).  A null text has no findings.
        """
        wanted = detect.enabled_types(self.entities)
        rules = detect.ENTITY_TYPES if enabled else wanted
        rows = df.withColumn("__norm", t.normalised(F.col(text)))
        parts = []
        if self.tagger is not None:
            rows = rows.withColumn("__tagged", ner.tag(F.col(text), self.tagger))
            parts.append(ner.candidates(F.col(text), F.col("__tagged")))
        parts.append(detect.detect(F.col("__norm"), rules, self.profile))
        rows, matched = self._with_terms(rows, text)
        if matched is not None:
            parts.append(matched)
        if terms:
            own = F.transform(F.coalesce(F.col(terms), F.array()), lambda x, i: F.struct(F.lit("").alias("key"), i.cast("long").alias("seq"), x["term"].alias("term"), x["entity_type"].alias("entity_type")))
            parts.append(F.when(F.size(F.coalesce(F.col(terms), F.array())) > 0, dictionary.match_pairs(F.col(text), own)).otherwise(F.array().cast(f"array<{CANDIDATE}>")))
        rows = rows.withColumn("__found", F.coalesce(F.concat(*parts), F.array().cast(f"array<{CANDIDATE}>")))
        if enabled:
            default = F.array(*map(F.lit, wanted))
            asked = F.when(F.size(F.coalesce(F.col(enabled), F.array().cast("array<string>"))) > 0, F.col(enabled)).otherwise(default)
            chosen = F.filter("__found", lambda c: F.array_contains(asked, c["entity_type"]))
            rows = rows.withColumn("__found", chosen)
        else:
            rows = rows.withColumn("__found", resolve.only(F.col("__found"), wanted)) if matched is not None or terms or self.tagger else rows
        rows = rows.withColumn("__chosen", resolve.resolve(F.col("__found")))
        found = F.when(F.col(text).isNotNull(), resolve.findings(F.col(text), F.col("__chosen"), F.col(block).cast("string")))
        return rows.withColumn(out, F.coalesce(found, F.array().cast(f"array<{FINDING}>"))).drop(*_OWN)

    def _with_terms(self, rows: DataFrame, text: str):
        """The dictionary's candidates, in its order whatever its size: a small one is part of the plan, a larger one is broadcast or joined by texts."""
        if isinstance(self.dictionary, DataFrame):
            terms = dictionary.listed(self.dictionary)
            few = [(r["term"], r["entity_type"]) for r in terms.orderBy("key", "seq").limit(dictionary.PLAN_TERMS + 1).collect()]
        else:
            few = [(term, entity) for term, entity in self.dictionary if term]
            terms = None
        if not few:
            return rows, None
        if len(few) <= dictionary.PLAN_TERMS:
            return rows, dictionary.match_terms(F.col(text), few)
        if terms is None:
            terms = rows.sparkSession.createDataFrame([("", i, *pair) for i, pair in enumerate(few)], dictionary.PAIR[len("struct<") : -1])
        return dictionary.with_pairs(rows, text, terms, "__pairs", "__key"), dictionary.match_pairs(F.col(text), F.col("__pairs"), lambda p: p["fold"])

    def findings(self, df: DataFrame, text: str = "text", block: str = "block_id", keep: Iterable[str] = ()) -> DataFrame:
        """One row per finding, with the columns ``keep`` of its block."""
        found = self.analyze(df.select(*dict.fromkeys([*keep, text, block])), text, block, "__findings")
        return t.one_row_each(found, list(keep), F.col("__findings"), "f").select(*keep, "f.*")

    def mask(self, df: DataFrame, text: str = "text", findings: str = "findings", accepted: str | None = None, mode: str = "character", character: str = mask.DEFAULT_CHARACTER, out: str = "masked") -> DataFrame:
        """Add ``out``: the text with accepted findings (a column of ids; none given: all) replaced, the last first.

        Findings that overlap have not come from an analysis; they are spliced one after another, by the offsets of the original text.
        """
        chosen = F.col(findings) if accepted is None else mask.accepted(F.col(findings), F.col(accepted))
        return df.withColumn(out, mask.masked(F.col(text), F.coalesce(chosen, F.array().cast(f"array<{FINDING}>")), mode, character))


def checked(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text is longer than a request may have raise an error."""
    return df.withColumn(text, F.when(F.length(text) > MAX_TEXT, F.raise_error(F.lit(f"a text has up to {MAX_TEXT} characters")).cast("string")).otherwise(F.col(text)))


def text_blocks(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows of plain text as blocks named ``text``."""
    return checked(df, text).withColumn("block_id", F.lit("text"))


def merged(findings: DataFrame, more: DataFrame) -> DataFrame:
    """Two sets of findings in order of block (as text), start and end."""
    return findings.unionByName(more).orderBy("block_id", "start", "end")


def semi_accepted(findings: DataFrame, accepted: DataFrame) -> DataFrame:
    """Findings whose id is among ``accepted`` (column id)."""
    return findings.join(accepted.select("id").distinct(), "id", "left_semi")
