"""Nearest neighbours: recall against brute force, exact answers on small tables, odd rows."""

import math

import numpy as np
import pandas as pd
import pytest

from oreline.llm import neighbours
from oreline.llm.queries import op4_neighbours


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1", "made"])
def test_recall(spark, folder, tmp_path):
    path = f"/root/testdata/{folder}"
    if folder == "made":  # clusters of vectors, more than one task has
        rng = np.random.default_rng(5)
        centres = rng.normal(size=(200, 32))
        made = centres[rng.integers(200, size=20_000)] + rng.normal(size=(20_000, 32))
        path = str(tmp_path)
        frame = pd.DataFrame({"vec_id": range(len(made)), "embedding": list(made)})
        frame.to_parquet(f"{path}/embeddings.parquet")
    rows = spark.read.parquet(f"{path}/embeddings.parquet").toPandas()
    expected = neighbours.brute_force(rows)
    got = op4_neighbours(spark, path).toPandas()
    assert len(got) == len(expected)
    pairs = set(zip(expected.query_id, expected.vec_id, strict=True))
    recall = len(pairs & set(zip(got.query_id, got.vec_id, strict=True))) / len(pairs)
    assert recall >= 0.9, recall
    both = got.merge(expected, on=["query_id", "vec_id"])
    assert (both.score_x == both.score_y).all()
    ordered = got.sort_values(["query_id", "rank"])
    assert (ordered.groupby("query_id").score.diff().fillna(0) <= 0).all()


def test_graph_search_finds_nearly_all_nearest():
    rng = np.random.default_rng(3)
    lists = neighbours.fit(rng.normal(size=(8192, 16)), 512)
    x = neighbours._unit(rng.normal(size=(300, 16)))
    far = neighbours._distances(x, lists.centroids)
    found, _ = lists.search(x, neighbours.BEAM)
    assert np.mean(found[:, 0] == far.argmin(axis=1)) > 0.97
    hits = wanted = 0
    for i, (own, d) in enumerate(lists.within(x, 1.3)):
        exact = np.flatnonzero(far[i] <= 1.3 * far[i].min())
        hits, wanted = hits + len(set(own) & set(exact)), wanted + len(exact)
        assert np.allclose(d, far[i][own])
    assert hits > 0.97 * wanted


def test_small_lists_are_topped_up():
    lists = neighbours.fit(np.eye(64), 64)
    sizes = np.full(64, 2)
    for own, _ in lists.within(np.eye(64)[:5], 1.0, sizes, least=24):
        assert len(own) == 12


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(1, 120)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)]  # a crowd of equal vectors
    odd = [None, [], [0.0] * 4, [1.0, None, 2.0, 3.0], [math.nan, 1.0, 1.0, 1.0], [math.inf, 1.0, 1.0, 1.0], [1.0, 2.0]]
    rows += [(2000 + 50 * i, v) for i, v in enumerate(odd)]
    rows += [(None, [1.0, 1.0, 1.0, 1.0]), (50, [9.0, 9.0, 9.0, 9.0]), (50, rows[49][1])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = neighbours.nearest(frame).collect()
    clean = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            v = [*v, *[0.0] * (4 - len(v))]  # shorter vectors go on with zeros
            clean[i] = min(v, clean.get(i, v))
    ids = np.array(sorted(clean))
    x = np.array([clean[i] for i in ids])
    expected = set()
    for q in [i for i in ids if i % 50 == 0]:
        scores = neighbours.cosine(np.array(clean[q])[None], x)
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != q][:5]
        expected |= {(int(q), r + 1, int(ids[j])) for r, j in enumerate(order)}
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == expected and len(got) == len(expected)
    few = neighbours.nearest(frame.filter("vec_id in (1000, 1001, 50)")).collect()
    assert len(few) == 4
    assert neighbours.nearest(frame.filter("vec_id = 50")).count() == 0
    assert neighbours.nearest(frame.filter("vec_id = -1")).count() == 0


def test_blocks_do_not_change_the_result(spark, monkeypatch, sf_dir):
    whole = sorted(map(tuple, op4_neighbours(spark, sf_dir).collect()))
    monkeypatch.setattr(neighbours, "BLOCK_VECTORS", 40)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 3)
    assert sorted(map(tuple, op4_neighbours(spark, sf_dir).collect())) == whole


def test_many_ties_go_to_the_smallest_ids(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=8)
    order = rng.permutation(300)
    rows = [(int(i), [float(v) for v in base * 2.0 ** (int(j) % 200 - 100)]) for i, j in enumerate(order)]
    rows += [(300 + i, [float(v) for v in rng.choice([-1.0, 1.0], 4).repeat(2)]) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(frame).toPandas().sort_values(["query_id", "rank"])
    expected = neighbours.brute_force(frame.toPandas())
    assert got.vec_id.tolist() == expected.vec_id.tolist()
