"""Sharding: the law, slots, mixtures, equal texts, odd rows."""

import zlib
from collections import Counter

from oreline.llm import sharding
from oreline.llm.queries import op9_sharding


def check(rows, docs, shards):
    """docs: (doc_id, text)."""
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter(
        (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs
    )
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) <= set(range(shards))
    counts = [sizes[s] for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query(spark):
    path = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    rows = op9_sharding(spark, path).collect()
    check(rows, [(d.doc_id, d.text) for d in docs], 24)
    source = {d.doc_id: d.source for d in docs}
    every = Counter(source.values())
    mixture = Counter((r.shard, source[r.doc_id]) for r in rows)
    for s in every:  # each shard has its share of each source, but for a row at either end
        assert all(abs(mixture[(n, s)] - every[s] / 24) <= 2 for n in range(24))
    of, sources = {}, {}
    for r in rows:
        of.setdefault(r.text_crc32, []).append(r.shard)
        sources.setdefault(r.text_crc32, set()).add(source[r.doc_id])
    # equal texts of one source are neighbours, which only a cut parts; of others most are near
    alone = [len(set(x)) == 1 for t, x in of.items() if len(x) > 1 and len(sources[t]) == 1]
    assert alone and sum(alone) >= 0.7 * len(alone)
    spread = [max(x) - min(x) for x in of.values() if len(x) > 1]
    assert sum(x <= 1 for x in spread) >= 0.95 * len(spread)
    assert sorted(map(tuple, op9_sharding(spark, path).collect()), key=repr) == sorted(map(tuple, rows), key=repr)


def test_odd_rows_and_a_crowd_of_copies(spark, monkeypatch):
    docs = [(i, f"text {i}", "a" if i % 3 else None) for i in range(200)]
    docs += [(1000 + i, "the same", "hot") for i in range(300)]
    docs += [(5, None, "b"), (5, "", "b"), (5, "", "b"), (None, None, None), (None, "x" * 2_000_000, "c")]
    frame = spark.createDataFrame([(*d, 7, "z") for d in docs], "doc_id long, text string, source string, size int, key string")
    monkeypatch.setattr(sharding, "ROWS_PER_STRETCH", 16)
    check(sharding.shard(frame, 7).collect(), [d[:2] for d in docs], 7)
    check(sharding.shard(frame.limit(3), 7).collect(), [d[:2] for d in frame.limit(3).collect()], 7)
    assert sharding.shard(frame.filter("doc_id = -1"), 7).count() == 0


def test_small_sources_and_rows_without_ids_are_spread(spark):
    """Neither many sources of one row nor many equal rows without an id meet in one task."""
    from pyspark.sql import functions as F

    from oreline.llm.common import Scratch

    frame = spark.range(4000).selectExpr("id as doc_id", "'t' || id as text", "'s' || id as source")
    scratch = Scratch(spark, "test")
    offsets = frame.select(F.floor(sharding._offset(F.col("source"), 0) * 20).alias("stretch"))
    sizes = [r["count"] for r in offsets.groupBy("stretch").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 300
    rows = sharding.shard(frame, 8).collect()
    check(rows, [(i, f"t{i}") for i in range(4000)], 8)
    alike = spark.range(20_000).selectExpr("cast(null as bigint) as doc_id", "'same' as text", "'a' as source")
    cells = scratch.keep(sharding._keyed(alike, 0), "rows").groupBy("cell").count().collect()
    assert len(cells) == sharding.ID_CELLS and max(r["count"] for r in cells) < 200
    check(sharding.shard(alike, 8).collect(), [(None, "same")] * 20_000, 8)
