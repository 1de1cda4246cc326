"""Dense surrogate keys."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oreline.operators.copies import repeat_copies
from oreline.session import run_folder

# monotonically_increasing_id() keeps the partition number above this many bits of row position.
_POSITION_BITS = 33


def dense_key(
    df: DataFrame, name: str, order: list[str], copies: str | None = None
) -> DataFrame:
    """Add ``name`` = 1..n in the order of ``order`` (missing last), ties by the other columns.

    ``row_number`` without a partition would sort the table in one task. Here the rows are
    range-partitioned and sorted once, numbered within their partition, and shifted by the number
    of rows in the partitions before, a list no longer than the number of partitions. The sorted
    rows are written to the shared folder: range bounds come from a sample, so both uses of the
    partition numbers must see the same run, also after an executor was lost. That write runs when the
    function is called; the partition sizes are read from one column of it.

    ``copies`` names a count column: such a row stands for that many rows and takes that many keys.
    """
    spark = df.sparkSession
    rest = [c for c in df.columns if c not in order and c != copies]
    sort = [F.col(c).asc_nulls_last() for c in [*order, *rest]]
    numbered = (
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", _POSITION_BITS))
    )
    folder = run_folder(spark, "keys")
    numbered.write.parquet(folder)
    placed = spark.read.schema(numbered.schema).parquet(folder)
    position = F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))

    # One row per partition of the range shuffle, so this list is as short as the partition count.
    stands_for = F.lit(1) if copies is None else F.col(copies)
    sizes = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(stands_for).alias("keys"))
        .orderBy("_part")
        .collect()
    )
    repeated = any(row["keys"] != row["n"] for row in sizes)
    starts = accumulate((row["keys"] for row in sizes), initial=0)
    offsets = spark.createDataFrame(
        [(row["_part"], start) for row, start in zip(sizes, starts, strict=False)],
        "_p long, _offset long",
    )
    numbered = placed.join(F.broadcast(offsets), F.col("_part") == F.col("_p"))

    kept = [c for c in df.columns if c != copies]
    if not repeated:
        return numbered.select((F.col("_offset") + position + 1).alias(name), *kept)
    within = (
        Window.partitionBy("_part")
        .orderBy("_at")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    first = F.col("_offset") + F.coalesce(F.sum(copies).over(within), F.lit(0)) + 1
    spread = repeat_copies(numbered.select(first.alias("_first"), *kept, copies), copies, "_copy")
    return spread.select((F.col("_first") + F.col("_copy")).alias(name), *kept)
