"""Evaluation runs over gold sets: analyse, score, add metadata, check gates.  Also a command.

``python -m maskwright.plans.benchmark --dataset gold.jsonl --output report.json --fail-under-recall 0.95``
"""

from __future__ import annotations

import argparse
import importlib.metadata
import platform
import resource
import sys
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators import detect, evaluate, ner
from maskwright.plans.engine import Engine
from maskwright.sources import documents

PACKAGES = ("pyspark", "pyarrow", "pandas", "numpy")


def _version(name: str) -> str | None:
    try:
        return importlib.metadata.version(name)
    except importlib.metadata.PackageNotFoundError:
        return None


def predicted(gold: DataFrame, engine: Engine) -> DataFrame:
    """Gold samples with the engine's findings: each sample's own dictionary, and its own types if it names any."""
    return engine.analyze(gold, block="id", out="predicted", enabled="enabled_entities", terms="dictionary_terms")


def run(spark: SparkSession, dataset: str, engine: Engine | None = None) -> dict:
    """The report of a gold set.

    Rows are analysed together, so a sample's latency is the elapsed time shared out by text length.
    """
    engine = engine or Engine()
    started = time.perf_counter()
    available = ner.available(engine.tagger)
    load_ms = (time.perf_counter() - started) * 1000
    gold = documents.read_gold(spark, dataset).persist()
    try:
        samples, characters = gold.agg(F.count("*"), F.sum(F.length("text"))).first()
        rows = predicted(gold, engine).persist()
        started = time.perf_counter()
        rows.count()
        elapsed_ms = (time.perf_counter() - started) * 1000
        length = F.length("text").cast("long")
        results = rows.select(F.col("id").alias("sample_id"), length.alias("text_length"), F.col("entities").alias("gold"), "predicted", (length * elapsed_ms / max(1, characters)).alias("latency_ms"), "tags")
        report = evaluate.evaluate(results)
        splits = sorted(r["split"] for r in gold.select("split").distinct().collect())
        rows.unpersist()
    finally:
        gold.unpersist()
    report["metadata"] = {
        "dataset": dataset,
        "dataset_split": splits,
        "language": "ja",
        "nlp_available": available,
        "nlp_disabled": engine.tagger is None,
        "enabled_entities": list(engine.entities or detect.ENTITY_TYPES),
        "profile": engine.profile,
        "model_load_ms": round(load_ms, 3),
        "peak_rss_mb": round(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, 3),
        "python": platform.python_version(),
        "packages": {p: _version(p) for p in PACKAGES},
        "samples": samples,
    }
    return report


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Score the rules against a gold set")
    parser.add_argument("--dataset", required=True)
    parser.add_argument("--output")
    parser.add_argument("--entities", nargs="+")
    parser.add_argument("--profile", default="local", choices=sorted(detect.PROFILES))
    for gate in ("recall", "zero-miss-rate", "core-zero-miss-rate", "hard-negative-pass-rate"):
        parser.add_argument(f"--fail-under-{gate}", type=float)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    report = run(spark, args.dataset, Engine(entities=tuple(args.entities) if args.entities else None, profile=args.profile))
    text = documents.write_report(report, args.output)
    print(f"Wrote the report to {args.output}" if args.output else text, end="\n" if args.output else "")
    gates = evaluate.Gates(args.fail_under_recall, args.fail_under_zero_miss_rate, args.fail_under_core_zero_miss_rate, args.fail_under_hard_negative_pass_rate)
    failures = gates.failures(report)
    for f in failures:
        print(f, file=sys.stderr)
    return int(bool(failures))


if __name__ == "__main__":
    raise SystemExit(main())
