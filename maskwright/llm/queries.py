"""The queries of this package: op1 to op10, and the corpus pipeline's stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.deploy import ship

from . import bytebpe, common, kdtree, langid, omh, packing, quality, secrets, simhash, simple8b, tokens, urls

#: Fixed by the query: (host, path, verdict).
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
SHARDS = 16
#: A text whose language scores less is not kept by the pipeline.
LEAST_LANGUAGE_SCORE = 0.5


def split_pattern() -> str:
    """The pattern that splits text before the merges of the rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_simple8b_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    path = common.new_path(spark, "token-ids")
    simple8b.write_ids(common.table(spark, sf_dir, "documents"), path, tokens.vocabulary(tokens.WORD_BPE))
    return simple8b.read_ids(spark, path, with_ids=False)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out() & F.col("doc_id").isNotNull()))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "language.lang_pred", "language.score")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return bytebpe.round_trip(common.table(spark, sf_dir, "documents"), tokens.vocabulary(bytebpe.MULTI_BPE), split_pattern())


def op4_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), tokens.vocabulary(tokens.WORD_BPE))


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"


def op5_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, tokens.vocabulary(secrets.VOCABULARY), split_pattern()).select("doc_id", "found.*")
    counts = [f"cast(size(filter(base, x -> x.kind = '{k}')) as long) as n_{k}" for k in secrets.KINDS[:3]]
    return found.selectExpr("doc_id", *counts, f"sha2({_joined('base')}, 256) as base_sha256", f"{_joined('spans')} as spans")


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.compare(common.table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "block_probability")


def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = kdtree.shard(common.table(spark, sf_dir, "documents"), SHARDS)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.classes(common.table(spark, sf_dir, "documents")).select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op10_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    table = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    return quality.judge(docs, table).select("doc_id", *(f"judged.{f.split()[0]}" for f in quality.FIELDS.split(", ")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simple8b_ids, op2_language_id, op3_byte_bpe, op4_bin_slack_packing, op5_secret_spans, op6_order_minhash, op7_url_filter, op8_kd_shards, op9_simhash_pivots, op10_quality_ratio)
}
#: None of these can be stated in SQL (hashes, vocabularies, trained models); tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {}
