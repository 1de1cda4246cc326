"""Latest snapshot per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: str, recency: Column, ties: list[str]) -> DataFrame:
    """The row of each ``key`` with the greatest ``recency`` (missing is oldest).

    ``ties`` make the choice a function of the data. ``row_number = 1`` is planned as a group limit
    on both sides of the shuffle, so every task ships at most one row per key and a key holding
    much of the table does not land in one task.
    """
    newest_first = Window.partitionBy(key).orderBy(
        recency.desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties]
    )
    return (
        df.withColumn("_rank", F.row_number().over(newest_first))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )
