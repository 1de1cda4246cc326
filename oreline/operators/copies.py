"""Rows that occur many times, carried as one row and a count.

Counting copies is a plain aggregate, so a group of copies shrinks on the map side before anything
is shuffled. Operators that have to tell rows apart work on the counted form and repeat the rows
at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A row is repeated in place up to this many times; beyond it the copies are spread over tasks.
COPIES_PER_TASK_ROW = 10_000


def count_copies(df: DataFrame, count: str) -> DataFrame:
    """Distinct rows (nulls equal) with their number of occurrences."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(count))


def repeat_copies(
    df: DataFrame, count: str, index: str, per_row: int = COPIES_PER_TASK_ROW
) -> DataFrame:
    """Undo :func:`count_copies`: each row ``count`` times, ``index`` running from 0.

    Counts above ``per_row`` are first cut into blocks that are hashed over all tasks, so no task
    has to write out one huge group. The second branch is empty for ordinary data and reuses the
    shuffle of the first.
    """
    kept = [c for c in df.columns if c != count]
    small = df.filter(F.col(count) <= per_row)
    large = df.filter(F.col(count) > per_row)

    def repeated(rows: DataFrame, start: Column, size: Column) -> DataFrame:
        return rows.select(*kept, F.explode(F.sequence(start, start + size - 1)).alias(index))

    few = repeated(small.filter(F.col(count) > 0), F.lit(0).cast("long"), F.col(count))
    blocks = large.withColumn(
        "_block", F.explode(F.expr(f"sequence(0L, (`{count}` - 1) div {per_row})"))
    ).repartition(*kept, "_block")
    start = F.col("_block") * per_row
    many = repeated(blocks, start, F.least(F.lit(per_row), F.col(count) - start))
    return few.unionByName(many)
