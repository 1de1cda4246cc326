"""Decontamination: planted passages, paraphrases, clean texts, the SVD against numpy, odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from oreline.llm import decontaminate
from oreline.llm.queries import op8_decontaminate
from oreline.llm.tokens import words


def tokens(text):
    return words(pa.array([text], pa.string()))[0]


def planted_pairs(docs, items):
    """(doc_id, item_id) where the item's words stand in the text one after another."""
    found = set()
    wanted = {i.item_id: tokens(i.text) for i in items}
    begins = {}
    for item, own in wanted.items():
        begins.setdefault(int(own[0]), []).append(item)
    for d in docs:
        text = tokens(d.text)
        for at in np.flatnonzero(np.isin(text, np.array(list(begins), np.uint64))):
            for item in begins[int(text[at])]:
                own = wanted[item]
                if np.array_equal(text[at : at + len(own)], own):
                    found.add((d.doc_id, item))
    return found


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_planted_passages_are_found_and_clean_texts_are_not(spark, folder):
    folder = f"/root/testdata/{folder}"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    rows = op8_decontaminate(spark, folder).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    assert len(found) == len(rows)
    planted = planted_pairs(docs, items)
    assert planted and planted <= found
    # what else is found shares most words of an item in their order
    text, item = {d.doc_id: d.text for d in docs}, {i.item_id: i.text for i in items}
    for d, i in found - planted:
        own = tokens(item[i])
        assert decontaminate.common_words(own, tokens(text[d])) >= 0.6 * len(own)
    assert len({d for d, _ in found - planted}) <= 0.002 * len(docs)


def test_paraphrases(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(2000)]
    frequent = "the of and to in is".split()
    write = lambda n: [rng.choice(frequent) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]
    texts = [write(rng.randint(20, 400)) for _ in range(400)]
    items = [write(n)[:-3] + ["end."] + write(2) for n in (15, 30, 50, 150)]
    copies = {}
    for number, item in enumerate(items):
        for share in (0.0, 0.1, 0.25):
            changed = [rng.choice(vocabulary) if rng.random() < share and i < len(item) - 3 else w for i, w in enumerate(item)]
            at, doc = rng.randrange(150), 1000 + len(copies)
            copies[doc] = number
            texts.append(write(at) + changed + write(70))
    frame = spark.createDataFrame(
        [(i if i < 400 else 600 + i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"
    )
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, bench).collect()}
    assert found == set(copies.items())
    clean = decontaminate.without_contamination(frame, bench)
    assert {r.doc_id for r in clean.collect()} == set(range(400))


def test_projection_spans_the_main_directions(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "COMMON", 0)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(40)
    projection = decontaminate.fit(docs.repartition(3))[0].astype(np.float64)
    hashes, bounds, _ = words(pa.array([r.text for r in docs.collect()]))
    starts, _ = decontaminate._blocks(bounds, decontaminate.PASSAGE)
    ids = decontaminate._ids(hashes)
    rows = np.zeros((len(starts), decontaminate.VOCABULARY))
    passage = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(ids)]))
    np.add.at(rows, (passage, ids), 1)
    frequency = (rows > 0).sum(axis=0)
    weights = np.where(frequency > 0, np.log(1 + len(starts) / np.maximum(1, frequency)), 0)
    rows /= np.maximum(np.sqrt((rows * weights**2).sum(axis=1, keepdims=True)), 1e-12)
    rows *= weights
    _, sizes, right = np.linalg.svd(rows, full_matrices=False)
    basis = np.divide(projection, weights[:, None], out=np.zeros_like(projection), where=weights[:, None] > 0)
    captured = np.linalg.norm(rows @ basis) ** 2
    best = (sizes[: decontaminate.RANK] ** 2).sum()
    assert 0.75 * best <= captured <= best * 1.0001
    assert np.linalg.norm(basis.T @ right[0]) > 0.95


def test_odd_rows(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu."
    docs = [
        (1, passage),
        (1, passage),
        (None, "x " * 30 + passage.upper()),
        (2, None),
        (3, ""),
        (4, "%%% \n"),
        (5, "word " * 300_000 + passage + " word" * 100),
        (6, "alpha beta"),
        (7, "nothing of it here at all"),
    ]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(
        [(10, passage, 1), (11, None, 1), (12, "", 1), (13, "alpha beta", 1), (14, passage, 1)],
        "item_id long, text string, doc_id int",
    )
    rows = decontaminate.contaminated(frame, bench).collect()
    expected = [(d, i) for d in (1, 1, 5, None) for i in (10, 14)]
    assert sorted(((r.doc_id, r.item_id) for r in rows), key=repr) == sorted(expected, key=repr)
    clean = decontaminate.without_contamination(frame, bench)
    assert clean.columns == frame.columns
    assert sorted(r.doc_id for r in clean.collect()) == [2, 3, 4, 6, 7]
    empty = frame.filter("doc_id = 99")
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(frame, bench.filter("item_id = 99")).count() == 0
    assert decontaminate.without_contamination(frame, bench.filter("item_id = 99")).count() == len(docs)


def test_short_verbatim_items_of_frequent_words(spark):
    rng = random.Random(6)
    rare = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(4000)]
    items = ["What is the sum of two and two?", "is it of the", "the sum of all that is in the end of it"]
    frequent = "what is the sum of two and it all that in end".split()
    write = lambda n: [rng.choice(frequent) if rng.random() < 0.2 else rng.choice(rare) for _ in range(n)]
    docs, planted = [], set()
    for i in range(300):
        text = write(rng.randint(60, 300))
        if i % 5 == 0:
            item, at = i // 5 % 3, rng.randrange(len(text) + 1)
            text[at:at] = [items[item].upper()]
            planted.add((i, item))
        docs.append((i, " ".join(text)))
    # an item split between two texts is in neither
    docs += [(1000, " ".join(write(60) + ["what is the sum"])), (1001, "of two and two " + " ".join(write(60)))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontaminate.contaminated(frame, bench).collect()
    assert planted <= {(r.doc_id, r.item_id) for r in rows if r.lcs_share == 1.0}
    assert planted_pairs(frame.collect(), bench.collect()) == planted
    assert not {1000, 1001} & {r.doc_id for r in rows}
    assert not {r.doc_id for r in decontaminate.without_contamination(frame, bench).collect()} & {d for d, _ in planted}


def test_subsequences_at_once_equal_one_by_one():
    rng = np.random.default_rng(4)
    window = rng.integers(0, 9, (50, 40))
    passages = [rng.integers(0, 9, n) for n in (3, 17, 56)]
    masks = np.zeros((3, decontaminate.VOCABULARY + 1), np.uint64)
    for i, p in enumerate(passages):
        np.bitwise_or.at(masks[i], p, np.uint64(1) << np.arange(len(p), dtype=np.uint64))
    which = rng.integers(0, 3, 50)
    for row, p, length in zip(window, which, decontaminate._subsequences(window, which, masks), strict=True):
        assert decontaminate.common_words(passages[p], row) == length


def test_scripts_without_blanks_and_typographic_quotes(spark):
    rng = random.Random(8)
    scripts = {
        "zh": ([chr(0x4E00 + i) for i in range(3000)], "。", "，"),
        "ja": ([chr(0x3041 + i) for i in range(80)] + [chr(0x5000 + i) for i in range(900)], "。", "、"),
        "th": ([chr(0x0E01 + i) + m for i in range(46) for m in ("", "ิ", "้")], " ", " "),
    }
    write = lambda s, n: "".join(rng.choice(scripts[s][0]) + (scripts[s][2] if rng.random() < 0.06 else "") for _ in range(n))
    items = [write(s, n) + scripts[s][1] for s in scripts for n in (9, 26, 55, 140)]
    items.append('He said: "what is the name of that river in the north"?')
    docs, planted, number = [], set(), 0
    for s in scripts:
        for _ in range(60):
            docs.append((number, scripts[s][1].join(write(s, rng.randint(10, 60)) for _ in range(6))))
            number += 1
    for i, item in enumerate(items):
        s = list(scripts)[min(i // 4, 2)]
        for text in (write(s, 70) + scripts[s][1] + item + write(s, 70), item):
            docs.append((number, text.replace(': "', ": “").replace('"?', "”?")))
            planted.add((number, i))
            number += 1
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, bench).collect()}
    assert found == planted
    kept = decontaminate.without_contamination(frame, bench)
    assert {r.doc_id for r in kept.collect()} == set(range(180))


def test_a_benchmark_is_bounded_by_its_bytes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_BENCHMARK_BYTES", 100)
    bench = spark.createDataFrame([(1, "中" * 40)], "item_id long, text string")
    with pytest.raises(ValueError, match="120 bytes"):
        decontaminate.read_benchmark(bench)
