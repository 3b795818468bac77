"""Overlap resolution and the projection to findings: row by row, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import text as t
from maskwright.schema import CANDIDATE, FINDING, PRIORITY


def priority(source: Column) -> Column:
    by_rank: dict[int, list[str]] = {}
    for name, rank in PRIORITY.items():
        by_rank.setdefault(rank, []).append(name)
    pairs = [(source.isin(names), rank) for rank, names in by_rank.items()]
    first, *rest = pairs
    return reduce(lambda c, p: c.when(*p), rest, F.when(*first)).otherwise(1)


def only(found: Column, entities: list[str]) -> Column:
    """Candidates of the types; what is filtered here takes no part in resolution."""
    return F.filter(found, lambda c: c["entity_type"].isin(entities))


#: Candidates up to which all are compared with one another; of more, runs that overlap are resolved by themselves.
FEW = 16


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _greedy(ranked: Column) -> Column:
    """What is chosen of ranked candidates, in order of (start, end)."""

    def accept(chosen: Column, item: Column) -> Column:
        c = item["c"]
        clash = F.exists(chosen, lambda x: (c["start"] < x["end"]) & (c["end"] > x["start"]))
        return F.when(clash, chosen).otherwise(F.concat(chosen, F.array(c)))

    chosen = F.aggregate(F.array_sort(ranked), F.array().cast(f"array<{CANDIDATE}>"), accept)
    ordered = F.array_sort(F.transform(chosen, lambda c: F.struct(c["start"].alias("a"), c["end"].alias("b"), c.alias("c"))))
    return F.transform(ordered, lambda x: x["c"])


def _by_runs(ranked: Column) -> Column:
    """The same by runs of candidates that overlap one another, so the work follows the length of runs and not the square of all."""
    ordered = F.transform(F.array_sort(F.transform(ranked, lambda x: F.struct(x["a"].alias("a"), x.alias("x")))), lambda y: y["x"])

    def firsts(x: Column, ends: Column) -> Column:
        """Where runs begin: nothing before ends later."""
        places = F.transform(x, lambda c, i: F.when((i == 0) | (c["a"] >= F.array_max(F.slice(ends, 1, i))), i))
        return F.filter(places, lambda i: i.isNotNull())

    def chosen(run: Column) -> Column:
        return F.when(F.size(run) == 1, F.transform(run, lambda y: y["c"])).otherwise(_greedy(run))

    def runs(x: Column, first: Column) -> Column:
        cut = F.transform(first, lambda b, j: F.slice(x, b + 1, F.coalesce(F.get(first, j + 1), F.size(x)) - b))
        return F.flatten(F.transform(cut, chosen))

    # everything that is read more than once is made once
    return _bound(ordered, lambda x: _bound(F.transform(x, lambda c: c["c"]["end"]), lambda ends: _bound(firsts(x, ends), lambda first: runs(x, first))))


def resolve(found: Column) -> Column:
    """Greedy choice: the candidate of highest priority, score and length, leftmost, then first listed, and all that do not overlap it.

    Empty spans go.  The result is in order of (start, end).
    """
    # fields in the order of ranking, so that the array's natural order is the ranking
    ranked = F.transform(
        F.filter(found, lambda c: c["end"] > c["start"]),
        lambda c, i: F.struct((-priority(c["source"])).alias("p"), (-c["score"]).alias("s"), (c["start"] - c["end"]).alias("l"), c["start"].alias("a"), i.alias("i"), c.alias("c")),
    )
    # one candidate overlaps nothing but itself
    several = _bound(ranked, lambda r: F.when(F.size(r) <= FEW, _greedy(r)).otherwise(_by_runs(r)))
    return F.when(F.size(found) > 1, several).otherwise(F.filter(found, lambda c: c["end"] > c["start"]))


def findings(text: Column, chosen: Column, block: Column) -> Column:
    """Findings with ids, original text and rounded scores."""
    return F.transform(
        chosen,
        lambda c: F.struct(
            t.finding_id(block, c["start"], c["end"], c["entity_type"]).alias("id"),
            c["entity_type"].alias("entity_type"),
            c["start"].alias("start"),
            c["end"].alias("end"),
            t.piece(text, c["start"], c["end"]).alias("text"),
            F.round(c["score"], 3).alias("score"),
            c["source"].alias("source"),
            block.cast("string").alias("block_id"),
        ),
    ).cast(f"array<{FINDING}>")
