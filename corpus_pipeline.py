"""The corpus pipeline: toxicity, near-duplicates, benchmark leaks, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import decontam, mixing, near_dup, sharding, toxicity
from tracewell.llm._common import stored

#: A document with a score from here on goes.
TOXIC = 0.7
#: One epoch, so that the mix doesn't bring back copies; the budget is what its weights can be met from.
MIX = {"budget_share": 0.6, "max_epochs": 1, "domain_weights": {"d0": 2.0}, "lang_weights": {"en": 1.0, "de": 1.5, "es": 2.0, "fr": 1.5}}


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model, TOXIC)


def stage_near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return near_dup.without_near_duplicates(docs)


def stage_decontam(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fill the token budget at the target weights stay."""
    return mixing.mixed(docs, **MIX)


def stage_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its shard and slot."""
    return sharding.assign_shards(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("near_dup", stage_near_dup),
    ("decontam", stage_decontam),
    ("mixing", stage_mixing),
    ("sharding", stage_sharding),
]

#: SQL can't express the first three stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
