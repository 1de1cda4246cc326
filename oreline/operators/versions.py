"""End dates of a version history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oreline.operators.copies import count_copies, repeat_copies


def end_date_versions(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Set ``end`` to the day before the next version of the same ``key`` starts, null if none.

    Versions are ordered by ``start`` (missing last), then by the other columns. A ``lead`` over
    the rows of a key would put a whole key into one task, so the window runs over the distinct
    start days of a key instead, of which there are never more than days in the calendar:

    * the last row of a (key, start) group ends the day before the next distinct start;
    * every row before it is followed by a row with its own start, so it ends the day before that.

    The rows meet their group again in an inner join, both sides of which can be split when skewed.
    """
    rest = [c for c in df.columns if c not in (key, start, end)]
    rows = count_copies(df.drop(end), "_copies")

    # With the copies summed up too, both sides need all of the counted rows: one scan and one shuffle
    # of them serve both.
    groups = (
        rows.groupBy(F.col(key).alias("_key"), F.col(start).alias("_start"))
        .agg(F.max(F.struct(*rest)).alias("_last"), F.sum("_copies").alias("_all"))
        .filter("_all > 0")
    )
    by_day = Window.partitionBy("_key").orderBy(F.col("_start").asc_nulls_last())
    groups = groups.withColumn("_next", F.lead("_start").over(by_day))

    joined = rows.join(
        groups,
        F.col(key).eqNullSafe(F.col("_key")) & F.col(start).eqNullSafe(F.col("_start")),
        "inner",
    )
    repeated = repeat_copies(joined, "_copies", "_copy")
    is_last = F.struct(*rest).eqNullSafe(F.col("_last")) & (F.col("_copy") == 0)
    ended = F.date_sub(F.when(is_last, F.col("_next")).otherwise(F.col(start)), 1)
    return repeated.withColumn(end, ended).select(*df.columns)
