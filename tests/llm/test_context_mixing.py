"""Context mixing: the trie and the base against plain counts, proper probabilities, held-out quality, odd rows."""

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oreline.llm import context_mixing as cm
from oreline.llm.queries import op11_context_mixing


def held_of(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def tokens_of(text):
    return [*(text or "").encode().lower().split(), b" "]


def plain(rows):
    """(n_tokens, n_known, train_tokens, base_score) of each row, by counting."""
    counts = Counter(w for i, t in rows if not held_of(i) for w in tokens_of(t))
    total, different = sum(counts.values()), len(counts)
    out = []
    for _, text in rows:
        words = tokens_of(text)
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (different + 1))) for w in words)
        out.append((len(words), sum(counts[w] > 0 for w in words), total, base))
    return out


def made(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(n)]
    words = sorted({w.encode() for w in words} | {b" "})
    m = np.array([rng.choice([0, 0, 1, 2, 30, 500]) for _ in words])
    return words, m


def spelled(words, m):
    letters = np.zeros(cm.SYMBOLS)
    for w, k in zip(words, m, strict=True):
        letters[cm.STOP] += k
        for b in w:
            letters[b] += k
    code = cm.huffman(letters)
    own = cm.spelled(words, code)
    ends = np.cumsum(own.sizes)
    return code, ["".join(map(str, own.bits[e - n : e])) for e, n in zip(ends, own.sizes, strict=True)]


def ways_of(words, m):
    code, bits = spelled(words, m)
    order = sorted(range(len(words)), key=bits.__getitem__)
    found = cm.walk([bits[i] for i in order], m[order], [(int(m.sum()), int((m > 0).sum()))])
    ways = [b""] * len(words)
    for i, way in zip(order, found, strict=True):
        ways[i] = way
    return code, bits, ways


def test_trie_against_plain_counts():
    words, m = made(1, 400)
    code, bits, ways = ways_of(words, m)
    assert len(set(bits)) == len(bits)
    for word in range(0, len(words), 7):
        expected, gates = [], []
        for depth in range(len(bits[word])):
            under = [i for i in range(len(words)) if bits[i].startswith(bits[word][:depth])]
            known, here = sum(m[i] > 0 for i in under), sum(m[i] for i in under)
            if known <= 1:
                break
            own = sum(m[i] for i in under if bits[i].startswith(bits[word][: depth + 1]))
            expected.append(int(cm._tenths(cm._odds(np.array([own]), np.array([here - own])))[0]))
            sure = own in (0, here)
            gates.append(cm.INSIDE + sum(here >= x for x in cm.NODE_COUNTS) + sure * (len(cm.NODE_COUNTS) + 1))
        way = cm.OFF if known == 0 else cm.KNOWN if m[word] else cm.REFUSED
        got = np.frombuffer(ways[word], np.int8)
        assert got[0] == way
        n = (len(got) - 1) // 2
        assert got[1 : 1 + len(expected)].tolist() == expected and n == len(expected) + (way != cm.OFF)
        assert got[1 + n : 1 + n + len(gates)].tolist() == gates


def test_paths_without_a_document_are_those_of_smaller_counts():
    words, m = made(5, 250)
    code, bits = spelled(words, m)
    order = sorted(range(len(words)), key=bits.__getitem__)
    bits, n = [bits[i] for i in order], m[order]
    d = np.maximum(n // 2, n > 0)  # words of one document, of documents with two tokens each
    left = cm.left_of(n, d)
    assert left[n == 1].tolist() == [0] * int((n == 1).sum()) and set(left[n == 500]) == {498}

    def under(counts):
        return [(counts.sum(), (counts > 0).sum())]

    paths, lone = cm.walk(bits, n, under(n), left)
    assert paths == cm.walk(bits, n, under(n))
    for word in np.flatnonzero(n):
        fewer = n.astype(float)
        fewer[word] = left[word]
        others = under(n)
        others[0] = (others[0][0] - n[word] + left[word], others[0][1] - (left[word] == 0))
        assert lone[word] == cm.walk(bits, fewer, others)[word]


def test_words_are_spelled_and_sent_in_parts():
    """What a task holds besides the words does not grow with all their bits, and no batch holds them all."""
    rng = np.random.default_rng(9)
    words = sorted({bytes(w) for w in rng.integers(97, 123, (100_000, 9)).astype(np.uint8)})
    code, bits = spelled(words, np.ones(len(words), np.int64))
    half = len(words) // 2
    parts = [words[: half + 5], words[half - 5 :]]
    sent = pa.table({
        "bucket": [3, 3], "chunk": [0, 1], "words": [cm._join(own) for own in parts],
        "n": [cm._packed(np.full(len(own), 2), "<i8") for own in parts], "d": [cm._packed(np.ones(len(own)), "<i8") for own in parts],
    })
    tracemalloc.start()
    merged = cm._merged(code)((pa.scalar(3),), sent)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 60e6
    assert max(b.num_rows for b in merged.to_batches()) <= 1 << 16
    assert merged["word"].to_pylist() == words and merged["bits"].to_pylist() == bits
    assert set(merged["bucket"].to_pylist()) == {3}
    assert Counter(merged["n"].to_pylist()) == {2: len(words) - 10, 4: 10} and sum(merged["d"].to_pylist()) == len(words) + 10
    found = list(cm._order_counts(code)(iter(merged.select(["word", "n"]).to_batches())))
    assert max(b.num_rows for b in found) <= 1 << 16
    assert sum(sum(b["both"].to_pylist()) for b in found) == cm.ORDERS * sum(n * len(b) for n, b in zip(merged["n"].to_pylist(), bits, strict=True))


def test_every_training_document_is_learned_from(spark, monkeypatch):
    """All are longer than a sample would take, and every word but two is in one document."""
    rng = random.Random(6)
    texts = [" ".join([f"w{i}x{rng.randrange(40_000)}" for _ in range(25_000)]) + f" all rare{i // 2}" for i in range(6)]
    assert min(map(len, texts)) > 200_000
    learned, weights = [], []
    first, merged = cm.first_voices, cm.merged_weights
    monkeypatch.setattr(cm, "first_voices", lambda at, tokens: (learned.append(int(tokens.sum())), first(at, tokens))[1])
    monkeypatch.setattr(cm, "merged_weights", lambda sums: weights.append(merged(sums)) or weights[-1])
    docs = spark.createDataFrame([*enumerate(texts), (90, "w3x7 all rare0")], "doc_id long, text string")
    got = cm.score(docs, F.col("doc_id") == 90).collect()
    total = sum(len(t.split()) + 1 for t in texts)
    assert learned == [total] and {r.train_tokens for r in got} == {total}
    assert not np.allclose(weights[0].mix, cm.fresh_weights().mix)
    # Without its document a word is unknown, so the trie refuses it, however many tokens it has there.
    assert {r.doc_id: r for r in got}[90].score < 0


def test_blocks_add_up_to_the_weights_of_all_words():
    words, n = made(7, 3000)
    code, bits = spelled(words, n)
    order = [i for i in sorted(range(len(words)), key=bits.__getitem__) if n[i]]
    words, n = [words[i] for i in order], n[order]
    d = np.maximum(n // 3, 1)
    _, lone = cm.walk([bits[i] for i in order], n, [(n.sum(), len(n))], cm.left_of(n, d))
    counts = np.zeros((cm.ORDERS, 1 << cm.SLOT_BITS, 2), np.float32)
    own = cm.spelled(words, code)
    for k in range(cm.ORDERS):
        np.add.at(counts[k], (own.slots[k], own.bits), np.repeat(n, own.sizes))
    whole, logs = cm.fit_block(words, n, d, lone, code, counts)
    parts = []
    for k in range(3):
        some = range(k, len(words), 3)
        parts.append(cm.fit_block([words[i] for i in some], n[k::3], d[k::3], [lone[i] for i in some], code, counts)[0])
    one, three = cm.merged_weights(whole), cm.merged_weights(sum(parts))
    tables = cm.order_tables(counts)
    costs = [cm.prices(words, lone, code, tables, w) @ n for w in (cm.fresh_weights(), one, three)]
    assert (costs[1] > costs[0]).all() and costs[2] == pytest.approx(costs[1], rel=0.01) and np.isfinite(logs).all()
    seen = whole[-cm.GATES * cm.BUCKETS :]
    assert np.allclose(seen.sum(), sum(p[-cm.GATES * cm.BUCKETS :].sum() for p in parts))
    assert seen.sum() >= 2 * int(n @ own.sizes) * 0.5


def test_first_voices_are_the_likeliest():
    rng = np.random.default_rng(8)
    share = np.array([0.5, 0.2, 0.15, 0.1, 0.05])
    voices = np.full((60_000, cm.VOICES), -30.0)
    voices[np.arange(60_000), rng.choice(cm.VOICES, 60_000, p=share)] = -1.0
    tally = cm.tallied(voices, np.full(60_000, 2))
    found = np.exp(cm.first_voices(np.flatnonzero(tally), tally[tally > 0]))
    assert tally.sum() == 60_000 and np.allclose(found[2], share, atol=0.01) and np.allclose(found.sum(axis=1), 1)


def test_alternatives_sum_to_one():
    rng = np.random.default_rng(0)
    inputs = rng.integers(-127, 128, (500, cm.PREDICTORS)).astype(np.int8)
    gate = rng.integers(0, cm.GATES, 500).astype(np.uint8)
    weights = cm.fresh_weights()
    chances = [cm._chances(cm.Decisions(None, None, x, gate), weights) for x in (inputs, -inputs)]
    assert np.allclose(chances[0] + chances[1], 1, atol=1e-6)


def test_words_share_one_probability():
    words, m = made(2, 300)
    every = [a + b for a in (b"", *[bytes([c]) for c in b"abcdefghij"]) for b in (bytes([c]) for c in b"abcdefghij")]
    words = sorted({*words, *every})
    m = np.array([dict(zip(*made(2, 300), strict=True)).get(w, 0) for w in words])
    code, _, ways = ways_of(words, m)
    tables = np.zeros((cm.ORDERS, 1 << cm.SLOT_BITS), np.int8)
    mixed, letters = np.exp(cm.prices(words, ways, code, tables, cm.fresh_weights()))
    assert 0.5 < mixed.sum() < 1 and 0 < letters.sum() < 1
    assert mixed[m > 0].sum() > 10 * mixed[m == 0].sum()


def test_voices_are_what_came_before():
    tokens = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4, 1, 2])
    sizes = np.array([9, 2])
    share, hit, state = cm._expected(tokens, sizes)
    assert np.allclose(share, [0, 0, 0, 1 / 3, 1 / 4, 1 / 5, 2 / 6, 2 / 7, 0, 0, 0])
    assert hit.tolist() == [False] * 4 + [True] * 4 + [False] * 3
    assert state.tolist() == [0, 0, 0, 0, 1, 3, 3, 3, 4, 0, 0]


def test_documents_do_not_depend_on_each_other():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 200, 600)
    n = int(sizes.sum())
    voices = np.log(rng.random((n, cm.VOICES)) * 0.1)
    voices[rng.random(n) < 0.3, 0] = -np.inf
    state = rng.integers(0, cm.STATES, n)
    start = cm.fresh_weights().voices
    whole, _ = cm.refine(voices, state, sizes, start)
    ends = np.cumsum(sizes)
    for k in (0, 7, 599):
        own = slice(ends[k] - sizes[k], ends[k])
        assert cm.refine(voices[own], state[own], sizes[k : k + 1], start)[0][0] == pytest.approx(whole[k], rel=1e-12)


def test_query_on_held_out_documents(spark):
    path = "/root/testdata/sf0.01"
    rows = op11_context_mixing(spark, path).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    expected = {i: (held_of(i), *own) for (i, _), own in zip(docs, plain(docs), strict=True)}
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == expected[r.doc_id][:4]
        assert r.base_score == pytest.approx(expected[r.doc_id][4], rel=1e-9)
        assert r.score < 0 and r.bits_per_byte > 0
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_chunks_and_cells_do_not_change_scores(spark, sf_dir, monkeypatch):
    whole = {r.doc_id: r for r in op11_context_mixing(spark, sf_dir).collect()}
    monkeypatch.setattr(cm, "CHUNK", 3000)
    monkeypatch.setattr(cm, "CELL_WORDS", 300)
    cut = op11_context_mixing(spark, sf_dir).collect()
    assert len(cut) == len(whole)
    for r in cut:
        assert r.score == pytest.approx(whole[r.doc_id].score, rel=1e-9)


def test_repetition_and_order_count(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(5)) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(1000, " ".join(["seldom heard words come back"] * 20)), (1001, " ".join(rng.sample(words, 100)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in cm.score(docs, F.col("doc_id") >= 1000).collect()}
    assert got[1000].score > got[1000].base_score * 0.5
    assert got[1001].n_known == 101


def test_odd_rows(spark):
    long_word = "x" * 50_000
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "one two"), (5, "One TWO é   three"), (5, "One TWO é   three"),
            (6, long_word), (7, f"{long_word}y {long_word}"), *[(20 + i, "one two three") for i in range(20)]]
    docs = spark.createDataFrame([(*r, "x", 1, [b"z"]) for r in rows], "doc_id int, text string, chunk string, n int, words array<binary>")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    got = cm.score(docs, held).collect()
    expected = sorted((str(i), held_of(i), *own[:3], round(own[3], 6)) for (i, _), own in zip(rows, plain(rows), strict=True))
    assert sorted((str(r[0]), *r[1:5], round(r.base_score, 6)) for r in got) == expected
    assert all(math.isfinite(r.score) for r in got)
    assert {r.doc_id for r in got if r.bits_per_byte is None} == {1, 2}
    assert cm.score(docs.filter("doc_id = -1"), held).count() == 0
    untaught = cm.score(docs, F.lit(True)).collect()
    assert len(untaught) == len(rows) and all(r.base_score == 0 and r.n_known == 0 and r.score < 0 for r in untaught)
