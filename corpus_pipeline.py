"""From raw documents to training shards: five stages, each a table of its own.

Every stage reads all rows that the stage before kept. Rows go where a stage rejects them: texts without a
recognised language, all but one document of a group of near duplicates, and texts that hold a
benchmark item. Mixing repeats and cuts documents so that sources meet their targets; sharding puts the
result into shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oreline.llm import decontaminate, language, mixing, sharding, simhash
from oreline.llm.common import Scratch, table

SHARDS = 24


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; the model is trained on the labelled ones."""
    return language.accepted(docs, language.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near duplicates, that of the smallest id."""
    return simhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.without_contamination(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated and cut so that each source has its target's words."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# Model training, fingerprints and the latent search can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; tables go to the shared folder, one at a time."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    done: list[str] = []
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(*done)
        done = [name]
    return docs
