"""Scores of predicted spans against gold spans.

Matching is local to a sample and needs no shuffle.  All sums are partial; a report's rows are one per
slice, mode and type.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.text import one_row_each
from maskwright.schema import InvalidInput

MODES = ("exact", "overlap")
HARD_NEGATIVE = "hard-negative"


def _indexed(spans: Column) -> Column:
    return F.transform(spans, lambda s, i: F.struct(s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), i.alias("i")))


def exact_pairs(gold: Column, predicted: Column) -> Column:
    """array<struct<g,p>>: equal type, start and end; of equal gold spans the last counts, of equal predictions the first."""

    def same(a: Column, b: Column) -> Column:
        return (a["entity_type"] == b["entity_type"]) & (a["start"] == b["start"]) & (a["end"] == b["end"])

    g, p = _indexed(gold), _indexed(predicted)
    last = F.filter(g, lambda a: ~F.exists(g, lambda b: same(a, b) & (b["i"] > a["i"])))
    first = F.filter(p, lambda a: ~F.exists(p, lambda b: same(a, b) & (b["i"] < a["i"])))
    pairs = F.transform(first, lambda b: F.struct(F.element_at(F.concat(F.transform(F.filter(last, lambda a: same(a, b)), lambda a: a["i"]), F.array(F.lit(-1))), 1).alias("g"), b["i"].alias("p")))
    return F.filter(pairs, lambda x: x["g"] >= 0)


def overlap_pairs(gold: Column, predicted: Column) -> Column:
    """array<struct<g,p>>: one to one, by intersection over union, then the higher gold and predicted place."""

    def pair(a: Column, b: Column) -> Column:
        inside = F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])
        union = F.greatest(a["end"], b["end"]) - F.least(a["start"], b["start"])
        hit = (a["entity_type"] == b["entity_type"]) & (inside > 0)
        return F.struct(F.when(hit, inside / union).otherwise(0.0).alias("share"), a["i"].alias("g"), b["i"].alias("p"))

    p = _indexed(predicted)
    every = F.flatten(F.transform(_indexed(gold), lambda a: F.transform(p, lambda b: pair(a, b))))
    best_first = F.reverse(F.array_sort(F.filter(every, lambda x: x["share"] > 0)))

    def take(acc: Column, x: Column) -> Column:
        used = F.exists(acc, lambda y: (y["g"] == x["g"]) | (y["p"] == x["p"]))
        return F.when(used, acc).otherwise(F.concat(acc, F.array(F.struct(x["g"].alias("g"), x["p"].alias("p")))))

    return F.aggregate(best_first, F.array().cast("array<struct<g:int,p:int>>"), take)


def matched(results: DataFrame) -> DataFrame:
    """Samples with, per mode, the places of matched pairs, misses and false positives.

    ``results``: sample_id, text_length, gold, predicted, latency_ms, tags.
    """
    rows = results.withColumn("exact", exact_pairs(F.col("gold"), F.col("predicted"))).withColumn("overlap", overlap_pairs(F.col("gold"), F.col("predicted")))
    for mode in MODES:
        rows = rows.withColumn(f"{mode}_misses", F.filter("gold", lambda s, i: ~F.exists(mode, lambda x: x["g"] == i)))
        rows = rows.withColumn(f"{mode}_false", F.filter("predicted", lambda s, i: ~F.exists(mode, lambda x: x["p"] == i)))
        rows = rows.withColumn(f"{mode}_hits", F.filter("gold", lambda s, i: F.exists(mode, lambda x: x["g"] == i)))
    return rows


def in_slices(rows: DataFrame) -> DataFrame:
    """Every sample in ``all`` and in ``core`` or ``hard_negative``."""
    own = F.when(F.array_contains("tags", HARD_NEGATIVE), "hard_negative").otherwise("core")
    return rows.withColumn("slice", F.explode(F.array(F.lit("all"), F.coalesce(own, F.lit("core")))))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _scores(rows: DataFrame) -> DataFrame:
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    rows = rows.withColumns({"precision": precision, "recall": recall})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rows.withColumn("f1", F.bround(f1, 6)).withColumns({c: F.bround(c, 6) for c in ("precision", "recall")})


def entity_scores(rows: DataFrame) -> DataFrame:
    """(slice, mode, entity_type, tp, fp, fn, precision, recall, f1); the type is null in the row over all types.

    ``rows``: samples as ``matched`` and ``in_slices`` give them.
    """

    def listed(mode: str, column: str, name: str) -> Column:
        return F.transform(column, lambda s: F.struct(F.lit(mode).alias("mode"), s["entity_type"].alias("entity_type"), *(F.lit(int(n == name)).alias(n) for n in ("tp", "fp", "fn"))))

    # all outcomes of a sample in one array, so that matching runs once
    outcomes = F.concat(*(listed(mode, f"{mode}_{kind}", name) for mode in MODES for kind, name in (("hits", "tp"), ("false", "fp"), ("misses", "fn"))))
    counted = one_row_each(rows, ["slice"], outcomes, "o").select("slice", "o.*")
    sums = [F.sum(n).alias(n) for n in ("tp", "fp", "fn")]
    per_type = counted.groupBy("slice", "mode", "entity_type").agg(*sums)
    total = per_type.groupBy("slice", "mode").agg(*sums).withColumn("entity_type", F.lit(None).cast("string"))
    return _scores(per_type.unionByName(total))


def document_rates(rows: DataFrame) -> DataFrame:
    """(slice, mode, samples, characters, gold, predicted, zero_miss_rate, no_false_positive_rate, false_positives_per_1000, zero_miss, no_false_positive, false_positives).

    Rates are rounded to six places; the counts that they are made of are exact.
    """
    shared = {"samples": F.count("*"), "characters": F.sum("text_length"), "gold": F.sum(F.size("gold")), "predicted": F.sum(F.size("predicted"))}
    own = {}
    for mode in MODES:
        own |= {
            f"{mode}_0": F.bround(F.avg((F.size(f"{mode}_misses") == 0).cast("double")), 6),
            f"{mode}_1": F.bround(F.avg((F.size(f"{mode}_false") == 0).cast("double")), 6),
            f"{mode}_2": F.bround(ratio(F.sum(F.size(f"{mode}_false")) * 1000, F.sum("text_length")), 6),
            f"{mode}_3": F.count_if(F.size(f"{mode}_misses") == 0),
            f"{mode}_4": F.count_if(F.size(f"{mode}_false") == 0),
            f"{mode}_5": F.sum(F.size(f"{mode}_false")),
        }
    agg = rows.groupBy("slice").agg(*(c.alias(n) for n, c in (shared | own).items()))
    names = ("zero_miss_rate", "no_false_positive_rate", "false_positives_per_1000", "zero_miss", "no_false_positive", "false_positives")
    by_mode = F.array(*(F.struct(F.lit(m).alias("mode"), *(F.col(f"{m}_{i}").alias(n) for i, n in enumerate(names))) for m in MODES))
    return agg.select("slice", *shared, F.explode(by_mode).alias("m")).select("slice", *shared, "m.*")


def latency(rows: DataFrame) -> DataFrame:
    """(slice, mean, median, p95, max, total, characters_per_second); p95 is the nearest rank."""
    total = F.sum("latency_ms")
    return rows.groupBy("slice").agg(
        F.bround(F.avg("latency_ms"), 3).alias("mean"),
        F.bround(F.median("latency_ms"), 3).alias("median"),
        F.bround(F.expr("percentile_disc(0.95) within group (order by latency_ms)"), 3).alias("p95"),
        F.bround(F.max("latency_ms"), 3).alias("max"),
        F.bround(total, 3).alias("total"),
        F.bround(ratio(F.sum("text_length"), total / 1000), 3).alias("characters_per_second"),
    )


def errors(rows: DataFrame) -> DataFrame:
    """(mode, sample_id, misses, false_positives) of samples that have any."""
    listed = F.array(*(F.struct(F.lit(m).alias("mode"), F.col(f"{m}_misses").alias("misses"), F.col(f"{m}_false").alias("false_positives")) for m in MODES))
    some = F.filter(listed, lambda x: (F.size(x["misses"]) > 0) | (F.size(x["false_positives"]) > 0))
    return one_row_each(rows, ["sample_id"], some, "e").select("e.mode", "sample_id", "e.misses", "e.false_positives")


def evaluate(results: DataFrame) -> dict[str, object]:
    """The report as nested dictionaries: over all samples, and per slice that has any."""
    kept = matched(results).persist()
    try:
        rows = in_slices(kept)
        rates = {(r["slice"], r["mode"]): r.asDict() for r in document_rates(rows).collect()}
        if not rates:
            raise InvalidInput("no results to evaluate")
        scores: dict[tuple, list] = {}
        for r in entity_scores(rows).orderBy("entity_type").collect():
            scores.setdefault((r["slice"], r["mode"]), []).append(r.asDict())
        times = {r["slice"]: r.asDict() for r in latency(rows).collect()}
        reports: dict[str, dict] = {}
        for name in times:
            report: dict[str, object] = {"latency_ms": {k: v for k, v in times[name].items() if k != "slice"}}
            for mode in MODES:
                rate = rates[name, mode]
                own = {r["entity_type"]: {k: v for k, v in r.items() if k not in ("slice", "mode", "entity_type")} for r in scores.get((name, mode), [])}
                micro = own.pop(None, {"tp": 0, "fp": 0, "fn": 0, "precision": 0.0, "recall": 0.0, "f1": 0.0})
                f1 = [v["f1"] for v in own.values()]
                report[mode] = {
                    "micro": micro, "macro_f1": round(sum(f1) / len(f1), 6) if f1 else 0.0, "document_zero_miss_rate": rate["zero_miss_rate"],
                    "document_no_false_positive_rate": rate["no_false_positive_rate"], "false_positives_per_1000_characters": rate["false_positives_per_1000"], "per_entity": own,
                }
            rate = rates[name, "exact"]
            report |= {"sample_count": rate["samples"], "character_count": rate["characters"], "gold_entity_count": rate["gold"], "predicted_entity_count": rate["predicted"]}
            reports[name] = report
        whole = reports.pop("all")
        listed: dict[str, list] = {m: [] for m in MODES}
        for r in errors(kept).collect():
            listed[r["mode"]].append({k: v for k, v in r.asDict(True).items() if k != "mode"})
        return whole | {"slices": reports, "errors": listed}
    finally:
        kept.unpersist()


@dataclass(frozen=True)
class Gates:
    recall: float | None = None
    zero_miss_rate: float | None = None
    core_zero_miss_rate: float | None = None
    hard_negative_pass_rate: float | None = None

    def failures(self, report: dict) -> list[str]:
        """What is below its limit; a slice that is missing fails its gate."""
        slices = report["slices"]
        found = {
            "recall": report["exact"]["micro"]["recall"],
            "zero_miss_rate": report["exact"]["document_zero_miss_rate"],
            "core_zero_miss_rate": slices.get("core", {}).get("exact", {}).get("document_zero_miss_rate"),
            "hard_negative_pass_rate": slices.get("hard_negative", {}).get("exact", {}).get("document_no_false_positive_rate"),
        }
        return [f"{k} {found[k] or 0.0:.6f} is below {limit:.6f}" for k in found if (limit := getattr(self, k)) is not None and (found[k] is None or found[k] < limit)]
