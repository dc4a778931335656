"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns what the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tendermill.llm import decontaminate, jaccard_join, mixing, quality_rules, sharding
from tendermill.llm.common import written
from tendermill.llm.entries import MIX_LEVELS, MIX_WEIGHTS, SHARDS, SLOTS, domain_of

#: Of the tokens that are left, so many percent are taken, each document once at most.
PIPELINE_PCT = 60


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines."""
    return quality_rules.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return jaccard_join.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken to the target weights of domains, languages and sources."""
    chosen = mixing.mix(docs.withColumn("domain", domain_of()), MIX_LEVELS, MIX_WEIGHTS, budget_pct=PIPELINE_PCT, max_epochs=1)
    return chosen.select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their slot and shard."""
    return sharding.assign_shards(docs, SHARDS, SLOTS)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mix),
    ("sharding", shard),
]

#: The near-duplicate stage is a probabilistic join with connected groups; SQL has no equal of it at any size.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
