"""The corpus pipeline: five stages, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sluiceway.llm import decontaminate, jaccard, langid, mixing, sharding, simhash
from sluiceway.llm.common import shared_dir
from sluiceway.sources.calls import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (null, or without a letter) go."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays, the one with the smallest id.

    SimHash over five-word shingles joins what differs in two bits at most. Most pairs at a similarity of 0.8 differ
    in more bits (about ten); what is left is therefore joined by the exact similarity of the same shingles.
    """
    return jaccard.drop_near_copies(simhash.drop_near_duplicates(docs, k=5))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shuffle_into_shards(docs, n_shards=8)


STAGES = [
    ("language id", language),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("source mixing", mix),
    ("sharding", shard),
]

#: Language models, vote fingerprints and hypergeometric draws have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
