"""Counts that describe a column; each shuffles partial counts only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metric_rows(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """One aggregate over ``df`` as tidy rows (``metric``, ``value``, ``n``); ``value`` is null."""
    one = df.agg(*[F.coalesce(m, F.lit(0)).cast("long").alias(k) for k, m in metrics.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("n")) for k in metrics])
    return one.select(F.inline(pairs)).select(
        "metric", F.lit(None).cast("string").alias("value"), "n"
    )


def value_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of several text columns with their counts, from one scan."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value"))
            for c in columns
        ]
    )
    return (
        df.select(F.inline(pairs))
        .groupBy("metric", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def flag_and_value_rows(
    df: DataFrame, flags: dict[str, Column], values: dict[str, Column]
) -> DataFrame:
    """Counts of flagged rows (``value`` null; also those of 0) and of distinct values, from one scan."""
    entry = [
        F.struct(F.lit(k).alias("metric"), F.lit(True).alias("flag"), F.lit(None).cast("string").alias("value"),
                 F.when(c, 1).otherwise(0).cast("long").alias("n"))
        for k, c in flags.items()
    ] + [
        F.struct(F.lit(k).alias("metric"), F.lit(False).alias("flag"), c.cast("string").alias("value"),
                 F.lit(1).cast("long").alias("n"))
        for k, c in values.items()
    ]
    counted = df.select(F.inline(F.array(*entry))).groupBy("metric", "flag", "value").agg(F.sum("n").alias("n"))
    # An empty table has no values, but its flags are 0.
    zeros = F.array(*[F.struct(F.lit(k).alias("metric"), F.lit(0).cast("long").alias("n")) for k in flags])
    none = df.sparkSession.range(1).select(F.inline(zeros))
    none = none.select("metric", F.lit(True).alias("flag"), F.lit(None).cast("string").alias("value"), "n")
    both = counted.unionByName(none).groupBy("metric", "flag", "value").agg(F.sum("n").alias("n"))
    return both.select("metric", "value", "n")


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per key; missing keys form one group."""
    return df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def duplicates() -> Column:
    """Aggregate over :func:`key_counts`: rows beyond the first of each key."""
    return F.sum(F.col("n") - 1)
