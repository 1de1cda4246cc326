"""Proportional stratified interleaving of documents into shards.

Rows are shuffled by a seed within each source; a row's fractional rank is its place in its source, moved on by the
source's seeded offset below 1, over the source's size. Sorted by fractional rank, every stretch of the order holds the sources in
the proportion of the whole, so cutting it into equal stretches makes every shard match the mixture; the offsets
spread sources of a row or a few evenly as well.

The shuffle key is the text's seeded digest, so equal texts of a source are neighbours, and those of several sources stand at
about the same fractional rank. Cuts fall between them all the same: of the groups of equal texts in the
test tables of 10,000 documents about a third lie in two or three shards, nearly all of these across sources.

Neither rank needs one task for a source: a rank is the number of rows in earlier cells plus the
place within a cell. Cells come from the digest of the text and then of the id, so that
a text with very many copies is spread as well, rows without an id by where they are read; there are at most
``CELLS`` a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreline.llm.common import Scratch, prefix_sums

LAW = "rows"
TEXT_CELLS, ID_CELLS = 4096, 256
CELLS = TEXT_CELLS * ID_CELLS
ROWS_PER_STRETCH = 8192


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.concat(F.lit(f"{seed}|"), text).cast("binary"))
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("?"), F.monotonically_increasing_id()))
    id_key = F.md5(F.concat(F.lit(f"{seed}|"), id_text).cast("binary"))
    keyed = docs.select(
        "doc_id",
        "source",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        key.alias("key"),
        id_key.alias("id_key"),
    )
    cell = F.concat(F.substring("key", 1, 3), F.substring("id_key", 1, 2))
    return keyed.withColumn("cell", F.conv(cell, 16, 10).cast("int"))


def _offset(source: Column, seed: int) -> Column:
    """A number between 0 and 1 drawn for a source."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), source.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32


def shard(docs: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``docs`` has doc_id, text and source; other columns are not read. Row counts of any two shards
    differ by one at most, and slots are numbered from 0 within a shard.

    Null texts count as empty (size 8, checksum 0). A null source is a source of its own, sorted
    last. Null ids are told apart by their place in the input. An empty table gives no rows. Writes two narrow tables to the shared folder when called.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    rows = scratch.keep(_keyed(docs, seed), "rows")
    sizes = rows.groupBy("source", "cell").agg(F.count("*").alias("rows"))
    cells = scratch.keep(
        prefix_sums(sizes, ["source"], ["cell"], "rows", "before").withColumn(
            "of", F.sum("rows").over(Window.partitionBy("source"))
        ),
        "cells",
    )
    total = cells.agg(F.sum("rows")).first()[0] or 0
    place = Window.partitionBy("source", "cell").orderBy("key", "id_key", "doc_id")
    numbered = rows.withColumn("place", F.row_number().over(place) - 1)
    ranked = numbered.alias("r").join(
        cells.alias("c"),
        F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.cell") == F.col("c.cell")),
    )
    rank = F.col("before") + F.col("place")
    stretches = max(1, total // ROWS_PER_STRETCH)
    fraction = (rank.cast("double") + _offset(F.col("r.source"), seed)) / F.col("of").cast("double")
    ranked = ranked.select(
        "doc_id", "size", "text_crc32", F.col("r.source").alias("source"), rank.alias("rank"),
        fraction.alias("fraction"),
        F.floor(fraction * stretches).cast("int").alias("stretch"),
    )
    ranked = scratch.keep(ranked, "ranked")
    lengths = prefix_sums(
        ranked.groupBy("stretch").agg(F.count("*").alias("rows")).withColumn("all", F.lit(0)),
        ["all"], ["stretch"], "rows", "before",
    )
    order = Window.partitionBy("stretch").orderBy(
        "fraction", F.col("source").asc_nulls_last(), "rank"
    )
    placed = ranked.withColumn("place", F.row_number().over(order) - 1).join(
        lengths.select("stretch", "before"), "stretch"
    )
    position = (F.col("before") + F.col("place")).cast("long")
    number = F.expr(f"(position * {shards}) div {max(1, total)}")
    first = F.expr(f"(shard * {max(1, total)} + {shards} - 1) div {shards}")
    return (
        placed.withColumn("position", position)
        .withColumn("shard", number.cast("int"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit(LAW).alias("law"),
            "shard",
            (F.col("position") - first).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


ORACLE = f"""
WITH r AS (
  SELECT doc_id, source, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size,
         coalesce(text, '') AS text, md5('0|' || coalesce(text, '')) AS key,
         md5('0' || coalesce('|' || CAST(doc_id AS VARCHAR), '')) AS id_key
  FROM documents),
k AS (
  SELECT *, substr(key, 1, 3) || substr(id_key, 1, 2) AS cell,
         (('0x' || substr(md5('0' || coalesce('|' || source, '')), 1, 8))::BIGINT ::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE AS moved,
         count(*) OVER (PARTITION BY source) AS n FROM r),
f AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY cell, key, id_key, doc_id) - 1 AS rank
  FROM k),
p AS (
  SELECT *, row_number() OVER (ORDER BY (CAST(rank AS DOUBLE) + CAST(moved AS DOUBLE)) / CAST(n AS DOUBLE),
                               source NULLS LAST, rank) - 1 AS position,
         count(*) OVER () AS total FROM f),
bits AS (
  SELECT i::BIGINT AS i, list_reduce(list_prepend(i::BIGINT, range(8)::BIGINT[]),
         lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END) AS crc
  FROM range(256) t(i)),
steps AS (SELECT list(crc ORDER BY i) AS t FROM bits),
s AS (
  SELECT *, CAST((position * 24) // total AS INTEGER) AS shard FROM p)
SELECT doc_id, size,
       xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
           lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) + 1 AS INTEGER)])),
           4294967295::BIGINT) AS text_crc32,
       'rows' AS law, shard,
       CAST(position - (shard * total + 23) // 24 AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM (SELECT *, list_transform(regexp_extract_all(hex(encode(text)), '..'),
                               lambda b: ('0x' || b)::BIGINT) AS bytes FROM s), steps
"""
