"""The corpus pipeline: five stages over ``documents``, each one operator of ``maskwright.llm``.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as
the next stage's ``docs``.  All stages but the last return the columns they were given, for the rows they keep:

1. language: texts without a determined language, or of an unsure one, go
2. quality: texts that fail the plain rules or the likelihood ratio go
3. near-dedup: of each group of near-duplicates the smallest id stays; groups are joined by fingerprints within two
   bits, as op9 has them, and by texts that share 0.8 of their five-word shingles
4. secrets: spans of secrets are replaced in the text, and ``n_chars`` follows
5. packing: one row per piece of a document, with its sequence and its place there

A stage learns from what its predecessor kept; labels are read from ``sf_dir``.

Nulls: a null or blank text goes at the first stage, as does one without letters; a null id is kept like any other, and is the smallest of
its group only if all are null.  Ties: of rows of equal id that are near-duplicates, the one of smallest hash of all values stays;
of equal rows one.  Texts of any length are read whole.  Empty tables give an empty result.  Other columns, whatever
their names, are kept as they are up to the last stage, which does not read them; ``n_chars``, if there, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.deploy import ship
from maskwright.llm import common, langid, packing, quality, secrets, simhash, tokens
from maskwright.llm.queries import LEAST_LANGUAGE_SCORE, split_pattern


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts whose language is determined with a score of at least ``LEAST_LANGUAGE_SCORE``."""
    ship(spark)
    model = langid.train(docs)
    (out,) = common.free_names(docs, "language")
    found = langid.predict(docs, model, out=out)
    keep = (F.col(f"{out}.lang_pred") != langid.UNDETERMINED) & (F.col(f"{out}.score") >= LEAST_LANGUAGE_SCORE)
    return found.where(keep).drop(out)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts that the rules and the ratio keep."""
    ship(spark)
    table = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    (out,) = common.free_names(docs, "judged")
    return quality.judge(docs, table, out=out).where(F.col(f"{out}.kept")).drop(out)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    ship(spark)
    return simhash.deduplicated(docs)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the text."""
    ship(spark)
    clean = secrets.redact(docs, tokens.vocabulary(secrets.VOCABULARY), split_pattern())
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences."""
    ship(spark)
    return packing.pack_documents(docs, tokens.vocabulary(tokens.WORD_BPE))


STAGES = [
    ("language id", language),
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("secret scans", secret_spans),
    ("best-fit packing", best_fit),
]

#: No stage can be stated in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with common.scratch(spark) as kept:
            found = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            kept.append(found)
        common.forget(docs)
        docs = found
    return STAGES[-1][1](spark, docs, sf_dir)
