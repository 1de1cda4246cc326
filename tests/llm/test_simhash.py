"""SimHash groups against a brute-force version."""

import random

import numpy as np
import xxhash

from oreline.llm import simhash
from oreline.llm.queries import op6_simhash


def brute_print(text):
    tokens = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    tokens = [t for t in __import__("re").split(r"[\x20\x09-\x0D]+", tokens) if t]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + 4]) for i in range(max(1, len(tokens) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(rows):
    """rows: (doc_id, print). The smallest id of each one's component."""
    prints = sorted({p for _, p in rows})
    values = np.array(prints, np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    label = np.arange(len(prints))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(prints))])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    of = dict(zip(prints, label.tolist(), strict=True))
    first = {}
    for d, p in rows:
        if d is not None:
            first[of[p]] = min(d, first.get(of[p], d))
    return [(d, f"{p:016x}", first.get(of[p])) for d, p in rows]


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = brute_components([(r.doc_id, brute_print(r.text)) for r in docs])
    assert sorted(map(tuple, op6_simhash(spark, sf_dir).collect())) == sorted(expected)


def test_chains_dense_groups_and_split_cells(spark, monkeypatch):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(200):  # a dense group
        prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    chain = rng.getrandbits(64)
    for _ in range(30):  # a chain of links
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
        prints.add(chain)
    prints |= {0, 1, 2**64 - 1, 2**63}
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in sorted(prints)]
    monkeypatch.setattr(simhash, "BLOCK", 16)
    frame = spark.createDataFrame(signed, "print long")
    scratch = simhash.Scratch(spark, "test")
    roots = simhash.components(simhash._edges(frame, scratch), scratch).collect()
    found = {np.int64(r.node).astype(np.uint64).item(): r.root for r in roots}
    expected = brute_components([(i, p) for i, p in enumerate(sorted(prints))])
    groups = {}
    for (_, _, first), p in zip(expected, sorted(prints), strict=True):
        groups.setdefault(first, set()).add(p)
    for members in groups.values():
        if len(members) > 1:
            assert len({found[p] for p in members}) == 1
    assert len({r for r in found.values()}) == sum(len(m) > 1 for m in groups.values())


def test_odd_rows(spark):
    rows = [
        (None, "a b c d e", "x"),
        (3, "a b c d e", "y"),
        (3, "a b c d e", "z"),
        (4, None, "x"),
        (5, "", "x"),
        (6, " \t\n", None),
        (7, "one", None),
        (8, "word " * 200_000, None),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame).collect()}
    assert {(4, "0" * 16, 4), (5, "0" * 16, 4), (6, "0" * 16, 4)} <= got
    assert {c for d, _, c in got if d in (None, 3)} == {3}
    kept = simhash.keep_one(frame).collect()
    assert sorted(r.doc_id for r in kept) == [3, 4, 7, 8]
    assert kept[0].asDict().keys() == {"doc_id", "text", "fingerprint"}
    empty = frame.filter("doc_id = 99")
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0
