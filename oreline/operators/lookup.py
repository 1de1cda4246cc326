"""Joins to lookup tables, and membership in them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Most bytes of lookups, as measured, that one plan copies to every executor.
BROADCAST_BYTES = 256 * 1024 * 1024
_ROW_OVERHEAD = 64


def measured_bytes(*tables: DataFrame) -> list[int]:
    """Upper estimates of the sizes of ``tables`` as broadcast tables, from one aggregate each."""

    def size(df: DataFrame, position: int) -> DataFrame:
        width = F.lit(_ROW_OVERHEAD + 16 * len(df.columns)).cast("long")
        for field in df.schema.fields:
            if field.dataType.typeName() in ("string", "binary"):
                width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
        total = F.coalesce(F.sum(width), F.lit(0)).alias("bytes")
        return df.agg(total).select(F.lit(position).alias("position"), "bytes")

    sizes = reduce(DataFrame.unionByName, [size(df, i) for i, df in enumerate(tables)]).collect()
    return [row["bytes"] for row in sorted(sizes, key=lambda row: row["position"])]


def broadcast_if_small(*tables: DataFrame, limit: int = BROADCAST_BYTES) -> list[DataFrame]:
    """Mark those of ``tables`` for broadcast that fit into ``limit`` together, the smallest first, as measured.

    Beyond it the join stays a shuffle join, whose skewed partitions are split at run time. The
    check matters for a fact table: left to run time alone, the large side would be shuffled
    before the small one is known to be small.
    """
    sizes, left, small = measured_bytes(*tables), limit, set()
    for position in sorted(range(len(tables)), key=sizes.__getitem__):
        if sizes[position] > left:
            break
        left -= sizes[position]
        small.add(position)
    return [F.broadcast(df) if i in small else df for i, df in enumerate(tables)]


def orphan_rows(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows whose ``key`` does not occur in ``known``; a missing key matches a missing key."""
    members = known.select(F.col(known_key).alias("_known")).distinct()
    return rows.join(members, F.col(key).eqNullSafe(F.col("_known")), "left_anti")


def orphan_count(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """One row: (``violations``, ``checked``), the orphan rows and all rows.

    Counted by grouping both sides on the key, which shuffles one partial count per key and task
    instead of the rows and treats missing keys as equal.
    """
    sides = rows.select(
        F.col(key).alias("k"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("known")
    ).unionByName(
        known.select(
            F.col(known_key).alias("k"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("known")
        )
    )
    per_key = sides.groupBy("k").agg(F.sum("n").alias("n"), F.bool_or("known").alias("known"))
    orphans = F.sum(F.when(~F.col("known"), F.col("n")))
    return per_key.agg(
        F.coalesce(orphans, F.lit(0).cast("long")).alias("violations"),
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("checked"),
    )
