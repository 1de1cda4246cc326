"""Toxicity: held-out quality, counts against brute force, odd rows."""

import zlib

import numpy as np
import pyarrow as pa

from oreline.llm import toxicity
from oreline.llm.queries import op1_toxicity
from oreline.llm.tokens import words


def test_words_of_batches_equal_words_one_by_one(monkeypatch):
    texts = ["Hello, World-2 hello", None, "", "Zürich ZÜRICH  x", "%%%", "a" * 50 + " b", "end"]
    hashes, bounds, stems = words(pa.array(texts), 5)
    assert np.diff(bounds).tolist() == [4, 0, 0, 3, 0, 2, 1]
    assert hashes[0] == hashes[3] and hashes[4] == hashes[5]
    single = [words(pa.array([t], pa.string()), 5) for t in texts]
    assert np.concatenate([s[0] for s in single]).tolist() == hashes.tolist()
    monkeypatch.setattr("oreline.llm.tokens.PIECE", 7)
    again, same, cut = words(pa.array(texts).slice(0), 5)
    assert again.tolist() == hashes.tolist() and same.tolist() == bounds.tolist()
    assert cut.tolist() == stems.tolist()
    part = words(pa.array(texts).slice(3, 2), 5)
    assert part[0].tolist() == hashes[4:7].tolist()


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op1_toxicity(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    toxic = [r.predicted for r in held if labels[r.doc_id] == 1]
    clean = [r.predicted for r in held if labels[r.doc_id] == 0]
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.02
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_odd_rows(spark):
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    ids = [i for i in range(400) if fold(i) != 2][:200]
    texts = {i: ("you vile fool of the town " if i % 3 == 0 else "a walk in the town of late ") * 3 for i in ids}
    docs = [(i, t, "x") for i, t in texts.items()]
    docs += [(900, None, "x"), (901, "", "x"), (902, "%%% \n", None), (903, "town fool " * 200_000, None)]
    docs += [(None, "vile fool", "x"), (904, "vile fools", "x"), (904, "vile fools", "x")]
    marks = [(i, int(i % 3 == 0)) for i in ids] + [(ids[0], None), (None, 1), (77777, 0), (ids[1], 7)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, label string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train(frame, labels)
    found = {}
    for r in toxicity.score(frame, model).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, found.values())) == len(docs)
    assert {found[i][0].evidence for i in (900, 901, 902)} == {0.0}
    assert found[None][0].predicted == 1 and found[None][0].held_out
    assert [r.predicted for r in found[904]] == [1, 1]
    empty = frame.filter("doc_id = -1")
    assert toxicity.score(empty, model).count() == 0
    nothing = toxicity.train(frame, labels.filter("doc_id = -1"))
    assert {r.predicted for r in toxicity.score(frame, nothing).collect()} == {0}


def test_packing_round_trip():
    for numbers in ([], [0], [0, 1, 2], [5, 70000, toxicity.WORD_BUCKETS - 1]):
        assert toxicity._unpack(toxicity._pack(np.array(numbers, np.int64))).tolist() == numbers


def test_counts_equal_brute_force(spark):
    docs = [(i, t) for i, t in enumerate(["a b a", "a c", "b", "c c d", "a d"] * 3)]
    marks = [(i, i % 2) for i, _ in docs]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    model = toxicity.train(frame, spark.createDataFrame(marks, "doc_id long, toxic int"))
    for word in "abcd":
        at = toxicity._buckets(pa.array([word]))[0][0]
        kept = [(t, y) for (i, t), (_, y) in zip(docs, marks, strict=True) if zlib.crc32(str(i).encode()) % 4 != 2]
        assert model.toxic[at] == sum(y == 1 and word in t.split() for t, y in kept)
        assert model.ordinary[at] == sum(y == 0 and word in t.split() for t, y in kept)
