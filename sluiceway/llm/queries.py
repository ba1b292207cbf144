"""The thin queries of the ten operators, by their registered names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm import decontaminate, html, langid, mixing, quality, sharding, simhash, substrings, suffixes, vectors
from sluiceway.llm.common import text_or_empty
from sluiceway.sources.calls import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text_or_empty()).cast("long") + 1).alias("size"),
        F.crc32(text_or_empty().cast("binary")).cast("long").alias("text_crc32"),
    )
    out = sharding.shuffle_into_shards(docs, n_shards=8)
    return out.select("*", F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract_pages(table(spark, sf_dir, "pages"))
    return out.select("*", F.length("text").cast("long").alias("n_chars"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_sharding, op3_decontamination, op4_html_extraction, op5_suffix_dedup, op6_substring_dedup,
        op7_embedding_dedup, op8_mixing, op9_language_id, op10_simhash,
    )
}
ORACLES = {"op3_decontamination": decontaminate.ORACLE, "op6_substring_dedup": substrings.ORACLE, "op8_mixing": mixing.ORACLE}
