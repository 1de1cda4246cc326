"""Hard negatives: trees and the whole search against brute force, odd rows, crowded labels and tiles."""

import math

import duckdb
import numpy as np
import pytest

from oreline.llm import hard_negatives
from oreline.llm.queries import op12_hard_negatives


def plain(rows, every=50, positives=5, negatives=3, low=50, high=95):
    """Rows (id, label, vector) -> the result, by looking at everything."""
    width = max((len(v) for *_, v in rows), default=1)
    x = np.array([[*v, *[0] * (width - len(v))] for *_, v in rows], object).reshape(len(rows), width)
    out = []
    for a, (anchor, label, _) in enumerate(rows):
        if anchor % every:
            continue
        scores = [int(s) for s in x @ x[a]]
        order = sorted((i for i in range(len(rows)) if i != a), key=lambda i: (-scores[i], rows[i][0]))
        for p in [i for i in order if rows[i][1] == label][:positives]:
            fits = [i for i in order if rows[i][1] != label and low * scores[p] <= 100 * scores[i] <= high * scores[p]]
            out += [(anchor, rows[p][0], r + 1, rows[i][0], scores[p], scores[i]) for r, i in enumerate(fits[:negatives])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, vector array<long>")


def made(seed, n, width=6, labels=4, most=40):
    rng = np.random.default_rng(seed)
    ids = rng.permutation(3 * n)[:n]
    return [(int(i), int(rng.integers(labels)), rng.integers(-most, most, width).tolist()) for i in ids]


@pytest.mark.parametrize("same", [True, False])
def test_tree_finds_what_a_scan_finds(same):
    rng = np.random.default_rng(8)
    x, labels = rng.integers(-9, 10, (1500, 5)), rng.integers(0, 5, 1500)
    ids, numbers = rng.permutation(1500), np.arange(1500)
    tree = hard_negatives.pack(x.astype(float), labels, ids, numbers)
    assert len(tree.levels[-1][0]) == 1 and len(tree.levels) == 3
    who = np.arange(0, 1500, 30)
    low, high = np.full(50, 10), np.full(50, 60)
    asked = hard_negatives.Asked(x[who].astype(float), labels[who], who, low, high, same)
    anchor, row, score = tree.search(asked, 4)
    for a in range(50):
        scores = x @ x[who[a]]
        fits = (numbers != who[a]) & ((labels == labels[who[a]]) == same) & (scores >= 10) & (scores <= 60)
        expected = sorted(np.flatnonzero(fits), key=lambda i: (-scores[i], ids[i]))[:4]
        assert tree.numbers[row[anchor == a]].tolist() == expected
        assert score[anchor == a].tolist() == scores[expected].tolist()


def test_boxes_are_pruned():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 3)) * 1000
    x = np.rint(np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 3)) * 20)
    tree = hard_negatives.pack(x, np.repeat(np.arange(40) % 4, 100), np.arange(4000), np.arange(4000))
    far = (x[:20] @ x[:20].T).max(axis=1)
    asked = hard_negatives.Asked(x[:20], np.zeros(20, int), np.arange(20), far * 0.9, far, False)
    _, left = tree.alive(asked)
    assert left.mean() < 0.3


def test_search_against_brute_force(spark, monkeypatch):
    rows = made(1, 900)
    whole = sorted(map(tuple, hard_negatives.mine(frame(spark, rows), every=9).collect()))
    assert whole == plain(rows, every=9) and len(whole) > 500
    for name, value in (("BLOCK_ROWS", 70), ("ANCHORS_AT_ONCE", 40), ("SAMPLE", 200)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert sorted(map(tuple, hard_negatives.mine(frame(spark, rows), every=9).collect())) == whole


def test_crowded_label_and_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 64)
    rows = made(2, 300, labels=3) + [(2000 + i, 7, [5, 5, 5, 5, 5, 5]) for i in range(400)]
    got = sorted(map(tuple, hard_negatives.mine(frame(spark, rows), every=50).collect()))
    assert got == plain(rows)


def test_odd_rows(spark):
    rows = made(4, 120) + [(50, 1, [3, 2, 1]), (50, 1, [3, 2, 1]), (100, 1, []), (7, 9, [2**29] * 6), (150, 9, [2**29 - 1] * 6)]
    odd = [(None, 1, [1] * 6), (200, None, [1] * 6), (250, 1, None), (300, 1, [1, None, 2])]
    data = frame(spark, rows + odd).selectExpr("*", "'x' as number", "1 as tile", "2 as block", "3 as part")
    assert sorted(map(tuple, hard_negatives.mine(data).collect())) == plain(rows)
    assert hard_negatives.mine(data.filter("vec_id = -1")).count() == 0
    assert hard_negatives.mine(data.filter("vec_id = 100")).count() == 0
    few = [r for r in rows if r[0] in (50, 100)]
    assert sorted(map(tuple, hard_negatives.mine(data.filter("vec_id in (50, 100)")).collect())) == plain(few)
    with pytest.raises(Exception, match="63 bits"):
        hard_negatives.mine(frame(spark, [(0, 1, [2**40]), (1, 1, [2**40]), (2, 2, [1])])).collect()


def test_prepared_rows(spark):
    bad = [None, [1.0, None], [math.nan, 1.0], [math.inf, 1.0]]
    rows = [(14, 9, [0.5, -0.001]), (8, 9, [0.0, 1.0]), *[(20 + i, 1, v) for i, v in enumerate(bad)], (1, None, [1.0])]
    frame_ = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, vector string")
    got = {tuple(map(str, r)) for r in hard_negatives.prepared(frame_).collect()}
    assert got == {("14", "0", "[128, -1]"), ("8", "9", "[0, 256]")}


def test_query_at_a_larger_size(spark):
    path = "/root/testdata/sf0.1"
    got = sorted(map(tuple, op12_hard_negatives(spark, path).collect()))
    other = duckdb.connect()
    other.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    assert got == sorted(other.execute(hard_negatives.ORACLE).fetchall()) and got
