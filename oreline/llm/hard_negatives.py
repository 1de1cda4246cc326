"""Hard negatives by inner product, searched in STR-packed R-trees.

* Tiles: cuts are fitted on a bounded sample (``SAMPLE`` rows, first by hash) at quantiles of the coordinates that vary
  most, one coordinate after the other. Every row falls into a tile; crowded tiles are dealt into
  blocks of about ``BLOCK_ROWS`` rows by hash.
* Trees: a task packs a block into an R-tree by sort-tile-recursion over the label and the widest coordinates. A box holds
  the least and the greatest of every coordinate and of the labels, so the inner products of an anchor
  with what is inside lie in an interval that follows coordinate by coordinate.
* Search: every anchor meets every block. Boxes whose labels do not count or whose interval lies outside the
  score window go with all that is below them; the leaves left are a queue, greatest bound first, and an anchor is done
  when the next bound is strictly below its k-th score. Ties with the k-th are thus never lost.

Positives come from a first search, which gives each anchor its windows for the second one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreline.llm.common import Scratch, among_first, drawn, ship_package

SAMPLE = 16_384
ROWS_A_CUT = 16  # sampled rows that a tile has at least
TILE_COORDINATES = 3
BLOCK_ROWS, ANCHORS_AT_ONCE = 8192, 2048
LEAF_ROWS, FAN_OUT = 64, 8
EXACT = 2**53  # whole numbers below are exact in double precision


def takes_part(vector: Column) -> Column:
    """Not null, and all components finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False))


def prepared(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part: labels of every seventh id moved on by one of
    ten, components as whole numbers floor(256 x)."""
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & takes_part(F.col("embedding"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("long"))
    return embeddings.filter(usable).select("vec_id", moved.alias("label"), whole.alias("vector"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of ``width`` numbers; shorter vectors go on with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(flat) == len(sizes) * width:
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _numbers(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type that holds every inner product of their rows exactly."""
    most = [max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0 for x in (a, b)]
    bound = most[0] * most[1] * max(1, a.shape[1])
    if bound >= 2**63:
        raise ValueError("inner products of these vectors do not fit into 63 bits")
    kind = np.float64 if bound < EXACT else np.longdouble
    return a.astype(kind), b.astype(kind)


@dataclass
class Tiles:
    """Nested cuts of some coordinates; a row's tile is numbered by the cell it falls into."""

    coordinates: list[int]
    parts: int
    cuts: dict[tuple[int, ...], np.ndarray]  # of each cell so far, where the next coordinate is cut

    def of(self, x: np.ndarray) -> np.ndarray:
        tile = np.zeros(len(x), np.int64)
        for depth, coordinate in enumerate(self.coordinates):
            part = np.zeros(len(x), np.int64)
            for cell in np.unique(tile):
                here = tile == cell
                part[here] = np.searchsorted(self.cuts[depth, int(cell)], x[here, coordinate], side="right")
            tile = tile * self.parts + part
        return tile


def fit_tiles(sample: np.ndarray, tiles: int) -> Tiles:
    """Cuts of the sample into about ``tiles`` equally full tiles."""
    coordinates = np.argsort(-sample.astype(np.float64).var(axis=0), kind="stable")[:TILE_COORDINATES].tolist()
    parts = max(1, round(tiles ** (1 / max(1, len(coordinates)))))
    fitted = Tiles([], parts, {})
    for depth, coordinate in enumerate(coordinates):
        tile = fitted.of(sample)
        share = np.arange(1, parts) / parts
        for cell in range(parts**depth):
            own = sample[tile == cell, coordinate]
            fitted.cuts[depth, cell] = np.quantile(own, share) if len(own) else np.zeros(parts - 1)
        fitted.coordinates.append(coordinate)
    return fitted


@dataclass
class Tree:
    """An R-tree over rows in packed order; ``levels`` go from the leaves' boxes up to a single one."""

    vectors: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    numbers: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # low, high, low label, high label

    def alive(self, asked: Asked) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor and leaf the greatest possible score, and whether the leaf is left."""
        positive, negative = np.maximum(asked.vectors, 0), np.minimum(asked.vectors, 0)
        left = np.ones((len(asked.vectors), 1), bool)
        most = np.zeros(left.shape)
        for low, high, low_label, high_label in reversed(self.levels):
            left = np.repeat(left, FAN_OUT, axis=1)[:, : len(low)]
            most = positive @ high.T + negative @ low.T
            least = positive @ low.T + negative @ high.T
            own = asked.labels[:, None]
            if asked.same:
                left &= (low_label <= own) & (own <= high_label)
            else:
                left &= (low_label != own) | (high_label != own)
            left &= (most >= asked.low[:, None]) & (least <= asked.high[:, None])
        return most, left

    def search(self, asked: Asked, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of each anchor's ``k`` best rows, those of smaller ids among equals."""
        most, left = self.alive(asked)
        most = np.where(left, most, -np.inf)
        queue = np.argsort(-most, axis=1, kind="stable")
        kth = np.full(len(asked.vectors), -np.inf)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, asked.vectors.dtype))
        open_anchors = np.arange(len(asked.vectors))
        for turn in range(queue.shape[1]):
            leaf = queue[open_anchors, turn]
            bound = most[open_anchors, leaf]
            on = (bound > -np.inf) & (bound >= kth[open_anchors])
            open_anchors, leaf = open_anchors[on], leaf[on]
            if not len(open_anchors):
                break
            found = [best]
            order = np.argsort(leaf, kind="stable")
            cuts = np.flatnonzero(np.diff(leaf[order])) + 1
            for group in np.split(order, cuts):
                rows = slice(leaf[group[0]] * LEAF_ROWS, (leaf[group[0]] + 1) * LEAF_ROWS)
                who = open_anchors[group]
                scores = asked.vectors[who] @ self.vectors[rows].T
                fits = (self.labels[rows] == asked.labels[who, None]) == asked.same
                fits &= (scores >= kth[who, None]) & (scores >= asked.low[who, None])
                fits &= (scores <= asked.high[who, None]) & (self.numbers[rows] != asked.numbers[who, None])
                at, row = np.nonzero(fits)
                found.append((who[at], row + rows.start, scores[at, row]))
            anchor, row, score = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((self.numbers[row], self.ids[row], -score, anchor))
            anchor, row, score = anchor[order], row[order], score[order]
            place = np.arange(len(anchor)) - np.searchsorted(anchor, anchor)
            last = place == k - 1
            kth[anchor[last]] = score[last]
            best = tuple(x[place < k] for x in (anchor, row, score))
        return best


@dataclass
class Asked:
    """Anchors, each with a label, a row number of its own, and the least and greatest score it asks for."""

    vectors: np.ndarray
    labels: np.ndarray
    numbers: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool  # rows of the same label count, or those of others


def pack(vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray, numbers: np.ndarray) -> Tree:
    """Sort-tile-recursion over the label and the widest coordinates, then boxes of boxes."""
    widest = np.argsort(-vectors.astype(np.float64).var(axis=0), kind="stable")[:TILE_COORDINATES]
    keys = [labels, *(vectors[:, c] for c in widest)]
    order = np.arange(len(vectors))
    slabs = [order]
    for depth, key in enumerate(keys):
        out = []
        for slab in slabs:
            slab = slab[np.argsort(key[slab], kind="stable")]
            leaves = -(-len(slab) // LEAF_ROWS)
            parts = max(1, round(leaves ** (1 / (len(keys) - depth))))
            size = -(-leaves // parts) * LEAF_ROWS
            out += [slab[i : i + size] for i in range(0, len(slab), size)]
        slabs = out
    order = np.concatenate(slabs)
    vectors, labels, ids, numbers = vectors[order], labels[order], ids[order], numbers[order]
    cuts = np.arange(0, len(order), LEAF_ROWS)
    boxes = tuple(f.reduceat(x, cuts, axis=0) for x in (vectors, labels) for f in (np.minimum, np.maximum))
    levels = [boxes]
    while len(levels[-1][0]) > 1:
        low, high, low_label, high_label = levels[-1]
        cuts = np.arange(0, len(low), FAN_OUT)
        levels.append((
            np.minimum.reduceat(low, cuts, axis=0), np.maximum.reduceat(high, cuts, axis=0),
            np.minimum.reduceat(low_label, cuts), np.maximum.reduceat(high_label, cuts),
        ))
    return Tree(vectors, labels, ids, numbers, levels)


def _packed(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    cells = (rows[c].to_numpy() for c in ("label", "vec_id", "number"))
    return matrix(rows["vector"], width), *cells


def _positives(width: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a block and a group of anchors: each anchor's best rows of its own label."""

    def search(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        asked_numbers, ids, numbers = (np.zeros(0, np.int64),) * 3
        if rows.num_rows and anchors.num_rows:
            vectors, labels, ids, numbers = _packed(rows, width)
            own, own_labels, _, asked_numbers = _packed(anchors, width)
            own, vectors = _numbers(own, vectors)
            tree = pack(vectors, labels, ids, numbers)
            ids, numbers = tree.ids, tree.numbers
            free = np.full(len(own), np.inf)
            found = tree.search(Asked(own, own_labels, asked_numbers, -free, free, True), k)
        anchor, row, score = found
        return pa.table({
            "anchor": asked_numbers[anchor], "positive_id": ids[row], "positive": numbers[row],
            "positive_score": score.astype(np.int64),
        })

    return search


def _negatives(width: int, k: int, low: int, high: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a block and a group of anchors with positives: the best rows of other labels in each window."""

    def search(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        who, ids, numbers, positives = (np.zeros(0, np.int64),) * 4
        if rows.num_rows and anchors.num_rows:
            vectors, labels, ids, numbers = _packed(rows, width)
            own, own_labels, _, asked_numbers = _packed(anchors, width)
            given = anchors["positives"].combine_chunks()
            at = np.repeat(np.arange(len(own)), given.value_lengths().to_numpy(zero_copy_only=False))
            flat = given.flatten()
            positives, scores = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("positive", "positive_score"))
            least, most = -(-low * scores // 100), high * scores // 100
            some = least <= most
            at, positives, least, most = at[some], positives[some], least[some], most[some]
            who = asked_numbers[at]
            own, vectors = _numbers(own, vectors)
            tree = pack(vectors, labels, ids, numbers)
            ids, numbers = tree.ids, tree.numbers
            found = tree.search(Asked(own[at], own_labels[at], who, least, most, False), k)
        question, row, score = found
        return pa.table({
            "anchor": who[question], "positive": positives[question], "negative_id": ids[row],
            "negative": numbers[row], "negative_score": score.astype(np.int64),
        })

    return search


def mine(
    vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """Hard negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score.

    ``vectors`` has vec_id (whole number), label (whole number) and vector (array of whole numbers); other columns are
    not read. A row's score is its inner product with the anchor; higher scores come first, ties by smaller vec_id.
    Anchors are the rows whose vec_id is divisible by ``every``; an anchor's positives its first ``positives`` other rows of
    the same label; for each of them come the first ``negatives`` rows of other labels whose score is ``low`` to ``high`` per
    cent of the positive's. Fewer rows give fewer; an anchor without positives, and a positive without negatives, have none.

    Rows with a null id, label, vector or component take no part. Shorter vectors count as if they went on with zeros, so an
    empty one has score 0 with all. Every row counts, also rows alike: copies of an anchor are anchors and
    can be its positives. Scores must fit into 63 bits, or the search stops with an error. An empty table gives an
    empty result. The tiled rows and the results of the blocks are written to the shared folder when this is called.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "negatives")
    usable = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "vector").filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull()
        & F.coalesce(F.forall("vector", lambda x: x.isNotNull()), F.lit(False))
    )
    rows = scratch.keep(usable.withColumn("number", F.monotonically_increasing_id()), "rows")
    count, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    if not count:
        shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return spark.createDataFrame([], shape)
    width = max(1, width)
    some = rows.withColumn("order", drawn("number")).filter(F.col("order") <= among_first(SAMPLE, count))
    sample = some.orderBy("order", "number").limit(SAMPLE).select("vector").toArrow()["vector"]
    tiles = fit_tiles(matrix(sample, width), min(-(-count // BLOCK_ROWS), max(1, len(sample) // ROWS_A_CUT)))

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = tiles.of(matrix(batch.column(2), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=[*batch.schema.names, "tile"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    shape = f"vec_id {kind}, label long, vector array<long>, number long, tile long"
    tiled = scratch.keep(rows.mapInArrow(tile, shape), "tiled")
    sizes = dict(map(tuple, tiled.groupBy("tile").count().collect()))  # SAMPLE / ROWS_A_CUT rows at most
    base, table = 0, []
    for number, size in sorted(sizes.items()):
        blocks = -(-size // BLOCK_ROWS)
        table.append((number, base, blocks))
        base += blocks
    places = F.broadcast(spark.createDataFrame(table, "tile long, base long, blocks long"))
    block = F.col("base") + F.pmod(F.xxhash64("number"), F.col("blocks"))
    placed = tiled.join(places, "tile").select("vec_id", "label", "vector", "number", block.alias("block"))

    anchors = rows.filter(F.col("vec_id") % every == 0)
    groups = max(1, -(-anchors.count() // ANCHORS_AT_ONCE))
    group = F.pmod(F.xxhash64("number"), F.lit(groups)).alias("part")

    def meet(asked: DataFrame, search: Callable[[pa.Table, pa.Table], pa.Table], shape: str) -> DataFrame:
        """Every group of anchors against every block."""
        blocks = placed.withColumn("part", F.explode(F.expr(f"sequence(0L, {groups - 1}L)")))
        everywhere = asked.select("*", group).withColumn("block", F.explode(F.expr(f"sequence(0L, {base - 1}L)")))
        both = blocks.groupBy("block", "part").cogroup(everywhere.groupBy("block", "part"))
        return both.applyInArrow(search, shape)

    shape = f"anchor long, positive_id {kind}, positive long, positive_score long"
    found = scratch.keep(meet(anchors, _positives(width, positives), shape), "found")
    best = Window.partitionBy("anchor").orderBy(F.col("positive_score").desc(), "positive_id", "positive")
    first = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives)
    first = scratch.keep(first.drop("place"), "positives")
    windows = first.groupBy("anchor").agg(F.collect_list(F.struct("positive", "positive_score")).alias("positives"))
    asked = anchors.join(windows, F.col("number") == F.col("anchor")).drop("anchor")
    asked = scratch.keep(asked, "asked")
    shape = f"anchor long, positive long, negative_id {kind}, negative long, negative_score long"
    found = scratch.keep(meet(asked, _negatives(width, negatives, low, high), shape), "mined")
    best = Window.partitionBy("anchor", "positive").orderBy(F.col("negative_score").desc(), "negative_id", "negative")
    mined = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    named = anchors.select(F.col("number").alias("anchor"), F.col("vec_id").cast("long").alias("anchor_id"))
    return (
        mined.join(first, ["anchor", "positive"])
        .join(named, "anchor")
        .select(
            "anchor_id",
            F.col("positive_id").cast("long").alias("positive_id"),
            "rank",
            F.col("negative_id").cast("long").alias("negative_id"),
            "positive_score",
            "negative_score",
        )
    )


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id AS id, a.label = v.label AS same,
         CAST(list_inner_product(a.e, v.e) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE p.place <= 5 AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
