"""Mixing: targets, streams, schedule and spans against plain versions, and odd rows."""

from collections import Counter

from oreline.llm import mixing
from oreline.llm.queries import op7_mixing


def water(sizes):
    """Targets by resharing the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, left, open_ = {}, float(sum(sizes.values())), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def check(rows, texts):
    """rows of the query, texts {doc_id: (source, words)}."""
    sizes = Counter()
    for source, n in texts.values():
        sizes[source] += n
    target, taken = water(sizes), Counter()
    for r in rows:
        source, n = texts[r.doc_id]
        assert r["size"] == n and r.source_size == sizes[source]
        assert abs(r.target - target[source]) <= 1e-6 * max(1, target[source])
        assert 0 <= r.taken <= 3 * n
        taken[source] += r.taken
    for source, n in target.items():
        assert abs(taken[source] - n) <= 0.5001


def test_query(spark):
    for folder in ("sf0.001", "sf0.01"):
        path = f"/root/testdata/{folder}"
        docs = spark.read.parquet(f"{path}/documents.parquet").collect()
        rows = op7_mixing(spark, path).collect()
        assert sorted(r.doc_id for r in rows) == sorted(d.doc_id for d in docs)
        check(rows, {d.doc_id: (d.source, len(d.text.split())) for d in docs})
        again = op7_mixing(spark, path).collect()
        assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_spans_cover_the_taken_words_and_follow_the_schedule(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spans, documents = mixing.mix(docs)
    spans, documents = spans.collect(), documents.collect()
    taken = Counter()
    seen = Counter()
    for s in spans:
        taken[s.doc_id] += s["words"]
        for w in range(s["first"], s["first"] + s["words"]):
            seen[(s.doc_id, s.epoch, w)] += 1
    assert set(seen.values()) == {1}
    assert taken == Counter({r.doc_id: r.taken for r in documents if r.taken})
    # low discrepancy: in the first half of the slots every source is close to its share
    slots = {(s.slot, s.source) for s in spans}
    total = len(slots)
    share = Counter(s for _, s in slots)
    half = Counter(s for n, s in slots if n < total / 2)
    assert all(abs(half[s] - share[s] / 2) <= 4 for s in share)


def test_odd_rows(spark):
    docs = [
        (1, "a b c", "x"),
        (1, "a b c", "x"),
        (2, None, "x"),
        (3, "", "y"),
        (4, " \n ", "y"),
        (5, "w " * 400_000, None),
        (6, "tiny", "z"),
        (None, "one two", "z"),
        (None, None, None),
        (7, "q " * 1000, "zz"),
    ]
    frame = spark.createDataFrame([(*d, 1, "t") for d in docs], "doc_id long, text string, source string, start int, target string")
    spans, documents = mixing.mix(frame)
    rows = documents.collect()
    assert len(rows) == len(docs)
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += len((text or "").split())
    target, taken = water(sizes), Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert r.taken <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 0.5001 for s in sizes)
    mixed = mixing.mixed_documents(frame).collect()
    assert sum(len(r.text.split()) for r in mixed) == sum(taken.values())
    assert spans.agg({"words": "sum"}).first()[0] == sum(taken.values())
    empty = frame.filter("doc_id = 99")
    assert mixing.mix(empty)[1].count() == 0 and mixing.mixed_documents(empty).count() == 0
    wordless = mixing.mix(frame.filter("source = 'y'"))[1].collect()
    assert [(r.target, r.taken) for r in wordless] == [(0.0, 0), (0.0, 0)]
