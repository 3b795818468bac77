"""Masking of accepted findings, by characters or by labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.schema import LABELS, InvalidInput

DEFAULT_CHARACTER = "█"
PDF_CHARACTER = "*"


def accepted(findings: Column, ids: Column) -> Column:
    """Findings whose id is accepted."""
    return F.filter(findings, lambda f: F.array_contains(ids, f["id"]))


def replaced(text: Column, findings: Column, by: Callable[[Column], Column]) -> Column:
    """Replace spans from the last to the first; spans outside the text, or empty, stay."""
    usable = F.filter(findings, lambda f: (f["start"] >= 0) & (f["end"] <= F.length(text)) & (f["end"] > f["start"]))
    last_first = F.reverse(F.array_sort(F.transform(usable, lambda f, i: F.struct(f["start"].alias("a"), (-i).alias("i"), f.alias("f")))))
    spliced = F.aggregate(last_first, text, lambda t, x: F.concat(F.substring(t, F.lit(1), x["f"]["start"]), by(x["f"]), F.substring(t, x["f"]["end"] + 1, F.length(t))))
    return F.when(F.size(findings) > 0, spliced).otherwise(text)


def by_character(text: Column, findings: Column, character: str = DEFAULT_CHARACTER) -> Column:
    """As many characters as the span has, so offsets stay."""
    if len(character) != 1:
        raise InvalidInput("the mask is one character")
    return replaced(text, findings, lambda f: F.repeat(F.lit(character), f["end"] - f["start"]))


def by_label(text: Column, findings: Column, labels: dict[str, str] | None = None) -> Column:
    """[label]; a type without a label stands for itself."""
    pairs = [F.lit(x) for kv in (LABELS if labels is None else labels).items() for x in kv]

    def label(f: Column) -> Column:
        known = F.try_element_at(F.create_map(*pairs), f["entity_type"]) if pairs else F.lit(None).cast("string")
        return F.concat(F.lit("["), F.coalesce(known, f["entity_type"]), F.lit("]"))

    return replaced(text, findings, label)


MODES = ("character", "entity_label")


def masked(text: Column, findings: Column, mode: str = "character", character: str = DEFAULT_CHARACTER, labels: dict[str, str] | None = None) -> Column:
    if mode not in MODES:
        raise InvalidInput(f"mode is one of {MODES}")
    return by_character(text, findings, character) if mode == "character" else by_label(text, findings, labels)


def segments(text: Column, findings: Column, ids: Column) -> Column:
    """The text as plain and marked segments in order: array<struct<text,entity_type,accepted>>; plain ones have no type."""
    kind = "struct<text:string,entity_type:string,accepted:boolean>"
    ordered = F.transform(F.array_sort(F.transform(findings, lambda f: F.struct(f["start"].alias("a"), f["end"].alias("b"), f.alias("f")))), lambda x: x["f"])
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

    def plain(a: Column, b: Column) -> Column:
        one = F.array(F.struct(F.substring(text, a + 1, b - a).alias("text"), F.lit(None).cast("string").alias("entity_type"), F.lit(None).cast("boolean").alias("accepted")))
        return F.when(b > a, one).otherwise(F.array().cast(f"array<{kind}>"))

    def add(acc: Column, f: Column) -> Column:
        own = F.array(F.struct(F.substring(text, f["start"] + 1, f["end"] - f["start"]).alias("text"), f["entity_type"].alias("entity_type"), F.array_contains(ids, f["id"]).alias("accepted")))
        return F.struct(f["end"].alias("at"), F.concat(acc["out"], plain(acc["at"], f["start"]), own).cast(f"array<{kind}>").alias("out"))

    return F.aggregate(ordered, start, add, lambda acc: F.concat(acc["out"], plain(acc["at"], F.length(text))))


def redistributed(text: Column, run_lengths: Column) -> Column:
    """Cut a text into runs of the given lengths, as an array."""
    starts = F.transform(run_lengths, lambda _, i: F.aggregate(F.slice(run_lengths, 1, i), F.lit(0), lambda a, x: a + x))
    return F.transform(F.arrays_zip(starts.alias("a"), run_lengths.alias("n")), lambda x: F.substring(text, x["a"] + 1, x["n"]))
