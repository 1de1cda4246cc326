"""The registered queries of the operators, over whole tables, and their statements for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreline.llm import (
    context_mixing,
    decontaminate,
    hard_negatives,
    language,
    licences,
    lines,
    mixing,
    neighbours,
    periodic,
    sharding,
    simhash,
    toxicity,
    warc,
)
from oreline.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return decontaminate.contaminated(docs, benchmark)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=24)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op2_licence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.windows(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.duplicates(table(spark, sf_dir, "documents"))


def op3_line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.classes(table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least=0).select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, documents = mixing.mix(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op11_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return context_mixing.score(table(spark, sf_dir, "documents"), held)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.prepared(table(spark, sf_dir, "embeddings")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.with_planted_runs(table(spark, sf_dir, "documents"))
    return periodic.digest(periodic.find_runs(docs))


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_licences": op2_licences,
    "op2_licence_windows": op2_licence_windows,
    "op3_line_dedup": op3_line_dedup,
    "op3_line_classes": op3_line_classes,
    "op4_neighbours": op4_neighbours,
    "op5_warc": op5_warc,
    "op6_simhash": op6_simhash,
    "op7_mixing": op7_mixing,
    "op8_decontaminate": op8_decontaminate,
    "op9_sharding": op9_sharding,
    "op10_language": op10_language,
    "op11_context_mixing": op11_context_mixing,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op2_licences": licences.ORACLE,
    "op2_licence_windows": licences.ORACLE_WINDOWS,
    "op3_line_dedup": lines.ORACLE,
    "op5_warc": warc.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op9_sharding": sharding.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
}
