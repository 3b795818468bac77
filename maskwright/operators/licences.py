"""A licence gate over (name, version, license) rows.  Also a command, over the packages of this Python.

``python -m maskwright.operators.licences --output inventory.json`` writes the inventory and ends with 1 if a package is rejected.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from importlib.metadata import distributions
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import text as t

# What is approved, other names for it, words that are no identifiers, and exceptions by package.
APPROVED = ("0BSD", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "ISCL", "MIT", "MIT-0", "MIT-CMU", "PSF-2.0", "Python-2.0", "CNRI-Python", "Unlicense", "Zlib")
ALIASES = {
    "Apache Software License": "Apache-2.0",
    "Apache License 2.0": "Apache-2.0",
    "BSD License": "BSD-3-Clause",
    "MIT License": "MIT",
    "Python Software Foundation License": "PSF-2.0",
    "ISC License (ISCL)": "ISC",
    "The Unlicense (Unlicense)": "Unlicense",
}
NOT_IDENTIFIERS = ("AND", "OR", "License", "Version", "Software", "Foundation")
EXCEPTIONS = {"certifi": ("MPL-2.0", "Mozilla Public License 2.0 (MPL 2.0)"), "tqdm": ("MPL-2.0 AND MIT",)}
COPYLEFT = r"(?U)(?i)(?:^|\W)(?:A?GPL|LGPL|MPL|EPL|CC-BY-SA|NONCOMMERCIAL)(?:\W|$)"
IDENTIFIER = "[A-Za-z0-9]+(?:-[A-Za-z0-9.]+)+"


def approved(licence: Column) -> Column:
    name = t.strip(licence)
    for alias, identifier in ALIASES.items():
        name = F.replace(name, F.lit(alias), F.lit(identifier))
    found = F.array_except(F.regexp_extract_all(name, F.lit(IDENTIFIER), F.lit(0)), F.array(*map(F.lit, NOT_IDENTIFIERS)))
    known = (F.size(found) > 0) & (F.size(F.array_except(found, F.array(*map(F.lit, APPROVED)))) == 0)
    return name.isin(*APPROVED) | (~name.rlike(COPYLEFT) & known)


def excepted(name: Column, licence: Column) -> Column:
    found = F.lit(False)
    for package, licences in EXCEPTIONS.items():
        found = found | ((F.lower(name) == package) & t.strip(licence).isin(*licences))
    return found


def inventory(packages: DataFrame, metadata: DataFrame) -> DataFrame:
    """Packages with their licence (of ``metadata`` (name, license) where unknown), policy exception and verdict."""
    known = metadata.select(F.lower("name").alias("__name"), F.col("license").alias("__license")).dropDuplicates(["__name"])
    joined = packages.join(known, F.lower(packages["name"]) == F.col("__name"), "left")
    unknown = F.upper(t.strip(F.col("license"))) == "UNKNOWN"
    rows = joined.withColumn("license", F.when(unknown, F.coalesce("__license", F.lit("UNKNOWN"))).otherwise(F.col("license")))
    exception = excepted(F.col("name"), F.col("license"))
    return rows.select("name", "version", "license", F.when(exception, F.lit("approved-commercial-use-exception")).alias("policy_exception"), (approved(F.col("license")) | exception).alias("permitted"))


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("permitted")).select(F.format_string("%s==%s: %s", "name", "version", "license").alias("package"))


def installed(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(packages, metadata) of this Python's distributions: licences by classifier, and by the fields that state them in words."""
    rows = []
    for d in distributions():
        if name := d.metadata.get("Name"):
            named = [c.rsplit(" :: ", 1)[-1] for c in d.metadata.get_all("Classifier") or () if c.startswith("License ::")]
            stated = d.metadata.get("License-Expression") or d.metadata.get("License")
            rows.append((name, d.version, "; ".join(named) or "UNKNOWN", stated))
    frame = spark.createDataFrame(sorted(set(rows), key=repr), "name string, version string, license string, stated string")
    return frame.drop("stated"), frame.where("stated is not null").select("name", F.col("stated").alias("license"))


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="List the licences of installed packages; fail if one is not permitted")
    parser.add_argument("--output", type=Path, required=True)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    rows = inventory(*installed(spark)).orderBy(F.lower("name"), "version").collect()  # a row per installed package
    listed = [{k: v for k, v in r.asDict().items() if v is not None} for r in rows]
    args.output.write_text(json.dumps(listed, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    bad = [f"{r['name']}=={r['version']}: {r['license']}" for r in rows if not r["permitted"]]
    for line in bad:
        print(line, file=sys.stderr)
    print(f"{len(rows)} packages, {len(bad)} rejected, {sum(r['policy_exception'] is not None for r in rows)} by exception")
    return int(bool(bad))


if __name__ == "__main__":
    raise SystemExit(main())
