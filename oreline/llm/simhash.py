"""SimHash near-duplicates, found by a grid join on bit counts per segment.

A 64-bit fingerprint is embedded as the bit counts of its 32 segments of two bits. The Manhattan
distance of two embeddings is a lower bound of the Hamming distance of the fingerprints, so pairs
within ``BOUND`` bits have embeddings within ``BOUND``, and the lower or the upper 16 coordinates within
``BOUND // 2``. Two lattice points that are no more than 2 apart have a lattice point within 1 of both. Every
fingerprint therefore enters, for each half, the grid cells within distance 1 of its embedding (25 on
average); fingerprints to be linked share a cell, and within a cell the exact distance is checked.

A cell gives no more than the edges of a spanning forest of its links (or the few links of a
small cell), never all pairs. Cells of more than ``BLOCK``
fingerprints are compared block against block, each pair of blocks in a task's memory of its
own, so that no cell, however crowded, has to be held or handled by one task. Components of the forest edges are
then the components of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreline.llm.common import Scratch, ship_package

BITS = 64
BOUND = 4
WORDS = 4
SEED = 42
BLOCK = 1024
FEW = 8  # members of cells whose pairs are checked directly
SHINGLES_AT_ONCE = 1 << 16
EVEN_BITS = 0x55555555
HALF = 0xFFFFFFFF


def fingerprint_text(text: str | None, words: int = WORDS) -> int:
    """The fingerprint as an unsigned number; 0 for a text without words, and for null."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    count = max(1, len(tokens) - words + 1)
    ones = np.zeros(BITS, np.int64)
    for first in range(0, count, SHINGLES_AT_ONCE):
        hashes = np.fromiter(
            (
                xxhash.xxh64_intdigest(b" ".join(tokens[i : i + words]), SEED)
                for i in range(first, min(count, first + SHINGLES_AT_ONCE))
            ),
            np.dtype("<u8"),
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > count, bitorder="little").tobytes(), "little")


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def udf(texts: pd.Series) -> pd.Series:
        prints = [fingerprint_text(t, words) for t in texts]
        return pd.Series(np.array(prints, np.uint64).view(np.int64))

    return udf(text)


def _cells(prints: DataFrame) -> DataFrame:
    """Rows (cell, print): every fingerprint in the grid cells of both halves.

    The embedding of a half is 16 numbers of 2 bits in one long; the next bits tell the halves apart.
    """
    halves = prints.select(
        "print",
        F.explode(
            F.array(
                F.struct(F.expr(f"print & {HALF}L").alias("half"), F.lit(0).alias("mark")),
                F.struct(F.expr("shiftrightunsigned(print, 32)").alias("half"), F.lit(1).alias("mark")),
            )
        ).alias("of"),
    )
    counts = f"of.half - (shiftrightunsigned(of.half, 1) & {EVEN_BITS}L)"
    halves = halves.select("print", F.expr(f"({counts}) | shiftleft(bigint(of.mark), 32)").alias("at"))
    near = F.expr(
        "array_append(filter(flatten(transform(sequence(0, 30, 2), i -> array("
        " if(shiftright(at, i) & 3 < 2, at + shiftleft(1L, i), null),"
        " if(shiftright(at, i) & 3 > 0, at - shiftleft(1L, i), null)))), c -> c is not null), at)"
    )
    return halves.select(F.explode(near).alias("cell"), "print")


def _forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Edges (smallest of a component, other member) over the links among some fingerprints."""
    bits = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= BOUND
    edges, left = [], np.ones(len(prints), bool)
    has_links = bits.sum(axis=0) > 1
    for start in np.flatnonzero(has_links):
        if not left[start]:
            continue
        left[start] = False
        front = np.array([start])
        while len(front):
            found = np.flatnonzero(bits[front].any(axis=0) & left)
            left[found] = False
            edges += [(int(start), int(i)) for i in found]
            front = found
    return edges


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; a group has 2 * BLOCK rows at most, and may span batches."""
    held_group, held_print = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def linked(group: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(group)])
        number = np.repeat(np.arange(len(starts)), sizes)
        a, b = [], []
        few = sizes[number] <= FEW
        for step in range(1, FEW):
            near = few[:-step] & (number[step:] == number[:-step])
            at = np.flatnonzero(near)
            at = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= BOUND]
            a.append(prints[at])
            b.append(prints[at + step])
        for first, size in zip(starts[sizes > FEW], sizes[sizes > FEW], strict=True):
            own = prints[first : first + size]
            if edges := _forest(own):
                picked = np.array(edges)
                a.append(own[picked[:, 0]])
                b.append(own[picked[:, 1]])
        both = [np.concatenate(x).view(np.int64) for x in (a, b)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in both], names=["u", "v"])

    held_group = held_group.reshape(0, 3)
    for batch in batches:
        group = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
        prints = batch.column(3).to_numpy().view(np.uint64)
        group, prints = np.r_[held_group, group], np.r_[held_print, prints]
        if not len(group):
            continue
        last = np.flatnonzero((group == group[-1]).all(axis=1))[0]
        held_group, held_print = group[last:].copy(), prints[last:].copy()
        if last:
            yield linked(group[:last], prints[:last])
    if len(held_group):
        yield linked(held_group, held_print)


def _edges(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (u, v) that connect exactly the fingerprints that links connect."""
    cells = _cells(prints)
    crowds = cells.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
    shared = cells.join(crowds, "cell", "left").withColumn(
        "blocks", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")
    )
    own = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    grouped = (
        shared.withColumn("own", own)
        .withColumn("other", other)
        .select(
            "cell",
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            "print",
        )
    )
    ordered = grouped.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "print")
    return scratch.keep(
        ordered.mapInArrow(_link_groups, "u long, v long").distinct(), "edges"
    )


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (node, root): of every node of ``edges`` (u, v), the smallest node it is connected to.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until nothing changes: the
    neighbours of a node are replaced by links to the smallest of them. The smallest is an aggregate, and
    the links are made by a join, so a node of very many neighbours is no task of its own.
    """
    spark = edges.sparkSession
    now = scratch.keep(
        edges.filter("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "links0",
    )

    def state(links: DataFrame) -> tuple:
        return tuple(
            links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        )

    before, step = state(now), 0
    while before[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        # every node links to the smallest of its neighbourhood, and so does the node itself
        large = large.union(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        large = scratch.keep(large, f"large{step + 1}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        then = scratch.keep(small, f"links{step + 1}")
        scratch.drop(f"links{step}", f"large{step + 1}")
        now, step = then, step + 1
        after = state(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        roots.select("node", F.col("node").alias("root"))
    )


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id of
    its component), group (the same for all of a component) and text_hash.

    ``docs`` has doc_id and text; other columns are not read. Texts without words, empty and null
    texts have fingerprint zero and are linked like any other. Repeated rows are returned as often as
    they occur. A null id is never a component_id unless the component has no other id. An empty
    table gives no rows. Long texts are hashed piece by piece. The fingerprints and the links
    found are written to the shared folder when this is called.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "simhash")
    printed = scratch.keep(
        docs.select(
            "doc_id",
            F.xxhash64("text").alias("text_hash"),
            fingerprint(F.col("text"), words).alias("print"),
        ),
        "prints",
    )
    distinct = scratch.keep(
        printed.groupBy("print").agg(F.min("doc_id").alias("first")), "distinct"
    )
    roots = components(_edges(distinct.select("print"), scratch), scratch)
    member = distinct.join(roots, F.col("print") == F.col("node"), "left").select(
        "print", "first", F.coalesce("root", "print").alias("group")
    )
    member = scratch.keep(member, "members")
    ids = member.groupBy("group").agg(F.min("first").alias("component_id"))
    classes = member.select("print", "group").join(ids, "group")
    return printed.join(classes, "print").select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
        "group",
        "text_hash",
    )


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id, all columns unchanged.

    Rows without an id stay only where their group has no row with one. Of rows alike in id and text
    one stays.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    first = near_duplicates(docs, words).groupBy("group", row.alias("row")).agg(
        F.count("*").alias("copies")
    )
    first = first.groupBy("group").agg(F.min(F.struct("row", "copies")).alias("first"))
    first = scratch.keep(
        first.select(
            F.col("first.row.doc_id").alias("_id"),
            F.col("first.row.text_hash").alias("_hash"),
            F.col("first.copies").alias("_copies"),
        ),
        "first",
    )
    # A row travels as one struct, so no column of it can clash with those made here.
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        "doc_id",
        F.xxhash64("text").alias("hash"),
    )
    chosen = rows.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")))
    place = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy("_copies"))
    copies = chosen.filter("_copies > 1").withColumn("_place", place).filter("_place = 1")
    return chosen.filter("_copies = 1").unionByName(copies.drop("_place")).select("row.*")
