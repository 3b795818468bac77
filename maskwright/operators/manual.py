"""Findings that a reviewer adds by selecting text, for one place or all places of a document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import text as t
from maskwright.operators import dictionary as dictionary_
from maskwright.schema import ENTITY_TYPES, FINDING, MANUAL_SOURCE, MAX_TERM, Conflict, InvalidInput, MaskwrightError, NotFound, struct_type

#: Fixed value: the note of a term that a selection saves.
NOTE = "レビュー画面から登録"


@dataclass(frozen=True)
class Selection:
    block_id: str
    start: int
    end: int
    entity_type: str
    scope: str = "single"
    save_to_dictionary: bool = False


@dataclass
class Added:
    """``findings`` are the new ones; ``skipped`` counts occurrences that overlap what was there."""

    findings: DataFrame
    term: str
    skipped: int
    dictionary_status: str = "not_requested"


def check_selection(blocks: DataFrame, existing: DataFrame, selection: Selection) -> tuple[str, int, int]:
    """(term, start, end) of the selection without blanks at its ends; errors in a fixed order."""
    if selection.scope not in ("single", "all"):
        raise InvalidInput("scope is single or all")
    if selection.entity_type not in ENTITY_TYPES:
        raise MaskwrightError("unknown entity type")
    chosen = blocks.where(F.col("block_id") == selection.block_id)
    raw = t.piece(F.col("text"), F.lit(selection.start), F.lit(selection.end))
    row = chosen.select(F.length("text").alias("n"), t.strip(raw).alias("term"), t.leading_blanks(raw).alias("lead")).limit(1).collect()
    if not row:
        raise MaskwrightError("no such block")
    if selection.start < 0 or selection.end > row[0]["n"] or selection.end <= selection.start:
        raise MaskwrightError("the selection is outside the text")
    term = row[0]["term"]
    start = selection.start + row[0]["lead"]
    end = start + len(term)
    if not term:
        raise MaskwrightError("the selection is blank")
    if len(term) > MAX_TERM:
        raise MaskwrightError(f"a selection has up to {MAX_TERM} characters")
    if not existing.where((F.col("block_id") == selection.block_id) & (F.col("start") < end) & (F.col("end") > start)).isEmpty():
        raise Conflict("the selection overlaps a finding")
    return term, start, end


def occurrences(blocks: DataFrame, term: str) -> DataFrame:
    """(block_id, start, end, text): exact occurrences, case and all, which do not overlap one another."""
    spans = t.mark_spans(t.unmarked(F.col("text")), "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E", guard=F.contains("text", F.lit(term)))
    return t.one_row_each(blocks, ["block_id"], spans, "s").select("block_id", "s.start", "s.end", "s.text")


def manual_findings(spans: DataFrame, entity_type: str) -> DataFrame:
    kind = F.lit(entity_type)
    rows = spans.select(
        t.finding_id(F.col("block_id"), F.col("start"), F.col("end"), kind).alias("id"), kind.alias("entity_type"), "start", "end", "text", F.lit(1.0).alias("score"), F.lit(MANUAL_SOURCE).alias("source"), "block_id"
    )
    return rows.select(*(F.col(f.name).cast(f.dataType) for f in struct_type(FINDING[len("struct<") : -1]).fields))


def without_overlap(spans: DataFrame, existing: DataFrame) -> DataFrame:
    """Spans that overlap no finding of their block: an interval anti-join."""
    e = existing.select(F.col("block_id").alias("__b"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    return spans.join(e, (F.col("block_id") == F.col("__b")) & (F.col("start") < F.col("__e")) & (F.col("end") > F.col("__s")), "left_anti")


def add(blocks: DataFrame, existing: DataFrame, selection: Selection, store: dictionary_.Dictionary | None = None) -> Added:
    """The findings that a selection adds to those of ``existing`` in the document ``blocks``.

    Occurrences of one term never overlap one another, so only existing findings can be in the way.
    """
    term, start, end = check_selection(blocks, existing, selection)
    if selection.scope == "single":
        spans = blocks.where(F.col("block_id") == selection.block_id).limit(1).select("block_id", F.lit(start).alias("start"), F.lit(end).alias("end"), F.lit(term).alias("text"))
    else:
        spans = occurrences(blocks, term)
    free = without_overlap(spans, existing)
    all_, kept = spans.count(), free.count()
    if not kept:
        raise Conflict("all occurrences overlap findings")
    status = "not_requested"
    if selection.save_to_dictionary and store is not None:
        status = "created" if store.get_or_create(term, selection.entity_type, NOTE)[1] else "already_exists"
    return Added(manual_findings(free, selection.entity_type), term, all_ - kept, status)


def remove(findings: DataFrame, finding_id: str) -> DataFrame:
    """Without a manual finding; others cannot be removed."""
    row = findings.where(F.col("id") == finding_id).select("source").limit(1).collect()
    if not row:
        raise NotFound("no such finding")
    if row[0]["source"] != MANUAL_SOURCE:
        raise MaskwrightError("only manual findings can be removed")
    return findings.where(F.col("id") != finding_id)
