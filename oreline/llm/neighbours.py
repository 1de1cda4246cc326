"""Approximate nearest neighbours by cosine with balanced posting lists.

* Fit: a bounded sample of vectors (``SAMPLE``, first by hash of the id) is halved again and again at the
  median between two means, which gives equally large leaves; their means are the lists' centroids.
* Index: every vector enters the list of its nearest centroid and, near a boundary, those of other
  centroids at most ``REPLICA_RATIO`` times as far, unless a chosen centroid is nearer to that one than the vector is.
* Search: a query takes all lists whose centroid is at most ``SEARCH_RATIO`` times as far as the nearest
  one, however many those are, and further ones while these hold too few entries for a full answer. Lists and their queries meet in blocks of bounded size and are compared exactly.

Centroids are searched in a proximity graph held in memory, by all vectors of a batch at once.

Equal vectors are one entry with the smallest ids that can appear in any result, so copies
neither crowd a list nor push other vectors out of the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreline.llm.common import Scratch, among_first, drawn, ship_package

SAMPLE = 16_384
VECTORS_A_LIST = 256
MOST_LISTS = 1024  # bounds the centroids every task holds
DEGREE, LONG_EDGES = 12, 4
BEAM = 32
REPLICAS = 4
REPLICA_RATIO = 1.1
SEARCH_RATIO = 1.22
BLOCK_VECTORS, BLOCK_QUERIES = 8192, 4096
ROUNDING = 1e-9  # more than the products of unit vectors can be off


def takes_part(vector: Column) -> Column:
    """Not null, not zero, and all components finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass
class Lists:
    """Centroids on the unit sphere and the graph over them."""

    centroids: np.ndarray
    graph: np.ndarray  # neighbours of each centroid
    entries: np.ndarray  # where searches begin

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest centroids found of every row, nearest first, and their distances."""
        n, lists = len(x), len(self.centroids)
        width = min(width, lists)
        if width * 2 >= lists:
            far = _distances(x, self.centroids)
            order = np.argsort(far, axis=1, kind="stable")[:, :width]
            return order, np.take_along_axis(far, order, axis=1)
        seen = np.zeros((n, lists + 1), bool)  # the last column stands for no centroid
        rows = np.arange(n)[:, None]
        beam = np.full((n, width), lists)
        far = np.full((n, width), np.inf)
        done = np.ones((n, width), bool)
        fresh = np.broadcast_to(self.entries, (n, len(self.entries)))
        while True:
            fresh = np.where(seen[rows, fresh], lists, fresh)
            fresh = np.sort(fresh, axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = lists
            seen[rows, fresh] = True
            seen[:, lists] = True
            real = fresh < lists
            at = np.where(real, fresh, 0)
            new = np.einsum("nd,nkd->nk", x, self.centroids[at])
            new = np.where(real, np.sqrt(np.maximum(0, 2 - 2 * new)), np.inf)
            beam = np.concatenate([beam, np.where(real, fresh, lists)], axis=1)
            far = np.concatenate([far, new], axis=1)
            done = np.concatenate([done, ~real], axis=1)
            order = np.argsort(far, axis=1, kind="stable")[:, :width]
            beam, far, done = (np.take_along_axis(a, order, axis=1) for a in (beam, far, done))
            if done.all():
                return beam, far
            # expand the nearest few that are not expanded yet
            turn = np.argsort(done, axis=1, kind="stable")[:, :4]
            expand = np.where(np.take_along_axis(done, turn, axis=1), lists, beam[rows, turn])
            done[rows, turn] = True
            around = np.r_[self.graph, np.full((1, self.graph.shape[1]), lists)]
            fresh = around[expand].reshape(n, -1)

    def within(
        self, x: np.ndarray, ratio: float, sizes: np.ndarray | None = None, least: int = 0
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each row, the centroids at most ``ratio`` times as far as the nearest; all that the graph finds.

        With the ``sizes`` of the lists, further ones are added until those before hold ``least`` entries. A
        row whose last centroid found is still wanted is searched again more widely.
        """
        out: list = [None] * len(x)
        open_rows, width = np.arange(len(x)), BEAM
        while len(open_rows):
            found, far = self.search(x[open_rows], width)
            near = far <= ratio * far[:, :1] + 1e-9
            if sizes is not None:
                own = np.r_[sizes, 0][found]
                near |= (np.cumsum(own, axis=1) - own < least) & (found < len(self.centroids))
            more = near[:, -1] & (width < len(self.centroids))
            for i in np.flatnonzero(~more):
                out[open_rows[i]] = (found[i][near[i]], far[i][near[i]])
            open_rows, width = open_rows[more], width * 4
        return iter(out)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(scale == 0, 1, scale)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def fit(sample: np.ndarray, lists: int, seed: int = 0) -> Lists:
    """Centroids of ``lists`` (a power of two) equally large leaves of the sample, and their graph."""
    rng = np.random.default_rng(seed)
    x = _unit(sample)
    leaves = [np.arange(len(x))]
    while len(leaves) < lists:
        halves = []
        for leaf in leaves:
            own = x[leaf]
            a, b = own[rng.integers(len(own))], own[rng.integers(len(own))]
            for _ in range(6):
                order = np.argsort(own @ (a - b), kind="stable")
                low, high = order[: len(order) // 2], order[len(order) // 2 :]
                a, b = own[high].mean(axis=0), own[low].mean(axis=0)
            halves += [leaf[low], leaf[high]]
        leaves = halves
    centroids = _unit(np.stack([x[leaf].mean(axis=0) for leaf in leaves]))
    count = len(centroids)
    near = min(DEGREE, count - 1)
    graph = np.zeros((count, near + LONG_EDGES), np.int64)
    for first in range(0, count, 512):
        far = _distances(centroids[first : first + 512], centroids)
        graph[first : first + 512, :near] = np.argsort(far, axis=1, kind="stable")[:, 1 : near + 1]
    graph[:, near:] = rng.integers(0, count, (count, LONG_EDGES))
    return Lists(centroids, graph, np.unique(rng.integers(0, count, 2 * BEAM)))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _posting(shared, ratio: float, sizes: np.ndarray | None = None, least: int = 0):
    """(rep, vector) -> (list, rep, vector): the lists that an entry is kept in or, given the ``sizes`` of
    the lists, those that a query takes."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Lists = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                x = _unit(_matrix(part.column(1)))
                lists, rows = [], []
                if sizes is None:
                    found, far = index.search(x, BEAM)
                    found, far = found[:, : 2 * REPLICAS], far[:, : 2 * REPLICAS]
                    kept = np.zeros(found.shape, bool)
                    kept[:, 0] = True
                    for j in range(1, found.shape[1]):
                        gaps = index.centroids[found[:, :j]] - index.centroids[found[:, j]][:, None]
                        gaps = np.linalg.norm(gaps, axis=2)
                        hidden = (kept[:, :j] & (gaps < far[:, j : j + 1])).any(axis=1)
                        near = far[:, j] <= ratio * far[:, 0]
                        kept[:, j] = near & ~hidden & (kept.sum(axis=1) < REPLICAS)
                    at = np.nonzero(kept)
                    rows, lists = at[0], found[at]
                else:
                    for i, (own, _) in enumerate(index.within(x, ratio, sizes, least)):
                        lists.append(own)
                        rows.append(np.full(len(own), i))
                    rows, lists = np.concatenate(rows), np.concatenate(lists)
                taken = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists.astype(np.int32)), *taken.columns], names=["list", *part.schema.names]
                )

    return post


def _compare(k: int):
    """Of a block of entries and a block of queries: each query's best entries, scored exactly."""

    def best(entries: pa.Table, queries: pa.Table) -> pa.Table:
        a, b = _matrix(queries["vector"]), _matrix(entries["vector"])
        out_q, out_e, out_s = [], [], []
        if len(a) and len(b):
            reps, asked = entries["rep"].to_numpy(), queries["rep"].to_numpy()
            ua, ub = _unit(a), _unit(b)
            most = min(len(b), k)
            for first in range(0, len(a), 512):
                close = ua[first : first + 512] @ ub.T
                least = np.partition(close, len(b) - most, axis=1)[:, len(b) - most]
                for row, line in enumerate(close >= least[:, None] - ROUNDING):
                    at = np.flatnonzero(line)  # all that may tie with the last one
                    exact = np.concatenate([cosine(a[first + row], b[at[i : i + 1024]]) for i in range(0, len(at), 1024)])
                    order = np.lexsort((reps[at], -exact))[:k]
                    out_e.append(reps[at[order]])
                    out_s.append(exact[order])
                    out_q.append(np.full(len(order), asked[first + row]))
        joined = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((out_q, "i8"), (out_e, "i8"), (out_s, "f8"))]
        return pa.table(dict(zip(("query", "rep", "score"), map(pa.array, joined), strict=True)))

    return best


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine along the last axis in double precision, the same whatever stands around."""
    return (a * b).sum(axis=-1) / (np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1)))


def nearest(
    vectors: DataFrame,
    every: int = 50,
    k: int = 5,
    replica_ratio: float = REPLICA_RATIO,
    search_ratio: float = SEARCH_RATIO,
) -> DataFrame:
    """The ``k`` nearest found of every row whose vec_id is divisible by ``every``: query_id, rank (from
    1), vec_id, score.

    ``vectors`` has vec_id and embedding (array of float or double). Candidates are all rows but the
    query's own. Equal scores go to the smaller vec_id. Rows take no part whose id or vector is null, or
    whose vector is empty, zero or holds null or non-finite components. Vectors shorter than the longest one go on with
    zeros. Rows that share a vec_id are one, with the smallest of their vectors. Queries without candidates have no rows. The distinct vectors and the
    results of the blocks are written to the shared folder when this is called.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "neighbours")
    usable = vectors.select("vec_id", F.col("embedding").alias("vector")).filter(
        F.col("vec_id").isNotNull() & takes_part(F.col("vector"))
    )
    width = usable.agg(F.max(F.size("vector"))).first()[0]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if width is None:
        return empty
    zero = F.lit(0).cast(usable.schema["vector"].dataType.elementType)
    padded = F.concat("vector", F.array_repeat(zero, F.lit(width) - F.size("vector")))
    padded = F.when(F.size("vector") == width, F.col("vector")).otherwise(padded)
    rows = usable.select("vec_id", padded.alias("vector"))
    rows = scratch.keep(rows.groupBy("vec_id").agg(F.min("vector").alias("vector")), "rows")
    # Of equal vectors only the k + 1 smallest ids can be among the k nearest of anything.
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    some = rows.withColumn("place", place).filter(F.col("place") <= k + 1)
    entries = some.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = scratch.keep(entries.select(F.col("ids")[0].alias("rep"), "ids", "vector"), "entries")
    asked = rows.filter(F.col("vec_id") % every == 0).alias("q")
    asked = asked.join(entries.alias("e"), F.col("q.vector") == F.col("e.vector"))
    asked = scratch.keep(asked.select(F.col("q.vec_id").alias("query_id"), "rep"), "asked")

    count = entries.count()
    some = entries.withColumn("order", drawn("rep")).filter(F.col("order") <= among_first(SAMPLE, count))
    sample = some.orderBy("order", "rep").limit(SAMPLE).select("vector").toArrow()["vector"]
    lists = 1
    while lists * VECTORS_A_LIST < count and lists < min(MOST_LISTS, len(sample) // 4):
        lists *= 2
    shared = spark.sparkContext.broadcast(fit(_matrix(sample), lists))
    kind = entries.schema["vector"].dataType.simpleString()
    shape = f"list int, rep long, vector {kind}"
    plain = entries.select("rep", "vector")
    posts = scratch.keep(plain.mapInArrow(_posting(shared, replica_ratio), shape), "posts")
    sizes = np.zeros(lists, np.int64)
    for row in posts.groupBy("list").count().collect():  # MOST_LISTS rows at most
        sizes[row["list"]] = row["count"]
    # An entry is in REPLICAS lists at most, so this many postings hold k + 1 entries.
    take = _posting(shared, search_ratio, sizes, (k + 1) * REPLICAS)
    wanted = plain.join(asked.select("rep").distinct(), "rep", "left_semi")
    probes = scratch.keep(wanted.mapInArrow(take, shape), "probes")

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:  # MOST_LISTS rows at most
        count = df.groupBy("list").count()
        return count.select("list", F.ceil(F.col("count") / size).cast("int").alias(name))

    grid = F.broadcast(
        blocks(posts, BLOCK_VECTORS, "rows_of").join(blocks(probes, BLOCK_QUERIES, "columns_of"), "list")
    )

    def spread(df: DataFrame, own: str, other: str, own_of: str, other_of: str) -> DataFrame:
        return df.join(grid, "list").select(
            "list",
            F.pmod(F.xxhash64("rep"), F.col(own_of)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(other_of) - 1)).alias(other),
            "rep",
            "vector",
        )

    left = spread(posts, "i", "j", "rows_of", "columns_of").groupBy("list", "i", "j")
    right = spread(probes, "j", "i", "columns_of", "rows_of").groupBy("list", "i", "j")
    found = left.cogroup(right).applyInArrow(_compare(k + 1), "query long, rep long, score double")
    found = scratch.keep(found, "found")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "rep")
    # An entry of several lists is found several times, at most REPLICAS.
    top = found.withColumn("place", F.row_number().over(best))
    top = top.filter(F.col("place") <= (k + 1) * REPLICAS).select("query", "rep", "score").distinct()
    named = top.join(entries.select("rep", "ids"), "rep")
    named = named.select("query", "score", F.explode("ids").alias("vec_id"))
    ranked = asked.join(named, F.col("query") == asked["rep"]).filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        ranked.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(F.col("query_id").cast("long"), "rank", F.col("vec_id").cast("long"), "score")
    )


def brute_force(rows: pd.DataFrame, every: int = 50, k: int = 5) -> pd.DataFrame:
    """The exact answer for a small table without odd rows, for measuring recall."""
    x, ids = np.stack(rows["embedding"].to_numpy()).astype(np.float64), rows["vec_id"].to_numpy()
    out = []
    for i in np.flatnonzero(ids % every == 0):
        scores = cosine(x[i][None], x)
        order = [j for j in np.lexsort((ids, -scores)) if j != i][:k]
        out += [(ids[i], r + 1, ids[j], scores[j]) for r, j in enumerate(order)]
    return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])
