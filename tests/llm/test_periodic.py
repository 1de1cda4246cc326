"""Periodic runs: agreement of places, runs and collapsed texts against plain versions, odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from oreline.llm import periodic
from oreline.llm.queries import op13_periodic_runs


def plain_runs(words):
    """Every maximal stretch of each smallest period, by trying all periods at all places."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - i
            if length >= max(6, 4 * q):
                found.setdefault((i, length), q)
            i = end + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def plain_text(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def plain_row(doc_id, text):
    words = plain_text(doc_id, text)
    runs = plain_runs(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    longest = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *longest, hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(kept).hexdigest(), len(words))


@pytest.mark.parametrize("letters", [1, 2, 3, 20])
def test_agreement_of_places(letters):
    rng = np.random.default_rng(letters)
    row = np.concatenate([[100], rng.integers(0, letters, 300), np.tile(rng.integers(0, letters, 7), 30), [101]])
    grammar = periodic.recompress(row)
    assert len(grammar.rows[-1]) == 1 and len(grammar.rounds) < 100
    i, j = rng.integers(1, len(row) - 1, (2, 3000))
    i, j = i[i != j], j[i != j]
    for way in (1, -1):
        expected = []
        for a, b in zip(i, j, strict=True):
            k = 0
            while row[a + k * way] == row[b + k * way]:
                k += 1
            expected.append(k)
        assert grammar.agree(i, j, way).tolist() == expected


def test_runs_against_plain_search():
    rng = random.Random(4)
    texts = []
    for _ in range(400):
        text = []
        while len(text) < rng.randint(0, 120):
            piece = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randint(1, 9))]
            text += piece * rng.choice([1, 1, 2, 4, 5, 9])
            text += piece[: rng.randint(0, len(piece))]
        texts.append(np.array(text, np.int64))
    found = periodic.stretches(texts)
    for text, runs in zip(texts, found, strict=True):
        assert [tuple(r) for r in runs.tolist()] == plain_runs(text.tolist())
    assert sum(map(len, found)) > 300
    for text in texts[:40]:
        alone = periodic.stretches([text])[0]
        assert [tuple(r) for r in alone.tolist()] == plain_runs(text.tolist())


def test_small_pieces_find_the_same(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [np.tile(rng.integers(0, 5, 1 + k % 11), 3 + k % 7) for k in range(80)]
    whole = [r.tolist() for r in periodic.stretches(texts)]
    monkeypatch.setattr(periodic, "PLACES_AT_ONCE", 7)
    assert [r.tolist() for r in periodic.stretches(texts)] == whole


def test_very_long_texts(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(50)}" for _ in range(100_000)]
    block = [f"v{rng.randrange(9)}" for _ in range(1000)]
    one = spark.createDataFrame(
        [(1, " ".join([*words, *block * 40, *words])), (2, "again " * 300_000)], "doc_id long, text string"
    )
    rows = {r.doc_id: r for r in periodic.find_runs(one).collect()}
    assert (100_000, 40_000, 1000) in [tuple(r) for r in rows[1].runs]
    assert rows[1].n_words == 240_000
    assert [tuple(r) for r in rows[2].runs] == [(0, 300_000, 1)] and rows[2].collapsed == "again"


def test_query_against_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in op13_periodic_runs(spark, sf_dir).collect()}
    short = [r for r in docs if len(r.text) < 6000]
    expected = {plain_row(r.doc_id, r.text) for r in short}
    assert expected <= got and len(got) == len(docs)
    assert sum(r[1] > 0 for r in expected) >= 10


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "a a a a a"), (5, "a a a a a a"), (None, "x y x y x y x y"),
        (7, "x y x y x y x y x y x y"), (8, "A a A a A a A a"), (8, "A a A a A a A a"),
        (9, "é é é é é é ü"), *[(i, "one two three four five six seven eight nine ten") for i in range(100, 140)],
    ]
    docs = spark.createDataFrame([(*r, "x", [1]) for r in rows], "doc_id long, text string, runs string, n_words array<int>")
    got = periodic.digest(periodic.find_runs(periodic.with_planted_runs(docs))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain_row(*r) for r in rows), key=repr)
    empty = periodic.digest(periodic.find_runs(docs.filter("doc_id = -1")))
    assert empty.count() == 0
    assert [f.dataType.simpleString() for f in empty.schema.fields[:7]] == ["bigint"] * 6 + ["string"]
