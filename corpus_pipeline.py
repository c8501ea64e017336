"""Documents to training shards, one stage after the other.

Every stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps
with their own columns; the last one adds ``shard`` and ``slot``.  An empty
table passes through all stages; null texts and those without a letter go with
the first; repeated rows are copies of each other for the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentiloom.llm import decontaminate, language, mixing, shards, simhash
from sentiloom.llm.common import store

SHARDS = 40


def language_identification(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go if they have no letter, or no language holds three tenths of their words.

    Languages are learned from the documents that name one.
    """
    return language.known_language(docs, language.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near fingerprints stays."""
    return simhash.dedup(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed by weight: documents are taken no, one or two times."""
    return mixing.mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its shard and its place in it, in place of columns so named."""
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("shard", "slot")]
    return shards.shards(docs, SHARDS).select(*own, "shard", "slot")


STAGES = [
    ("language_identification", language_identification),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("source_weights", source_weights),
    ("sharding", sharding),
]
#: SQL has neither the fingerprints' hash nor the mixtures' iteration; see the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
