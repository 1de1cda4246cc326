"""Licence scan against a brute-force version, and odd rows."""

import random
import re
import textwrap
from collections import Counter

from oreline.llm import licences
from oreline.llm.queries import op2_licence_windows, op2_licences


def bag(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return Counter(zip(words, words[1:], strict=False))


def brute(docs):
    notices = [(i, name, bag(text)) for i, (name, text) in enumerate(licences.NOTICES)]
    out = []
    for doc, text in docs:
        lines = [] if text is None else text.split("\n")
        units = list(enumerate(lines, 1)) + ([(0, text)] if len(lines) > 1 else [])
        for line, part in units:
            own = bag(part)
            found = []
            for i, name, other in notices:
                total = own.total() + other.total()
                dice = 2 * (own & other).total() / total if total else 0
                if dice >= 0.8:
                    found.append((-dice, i, name))
            if found:
                dice, i, name = min(found)
                out.append((doc, line, name, i, round(-dice, 12)))
    return out


def rows(frame):
    return sorted((r.doc_id, r.line, r.licence, r.template, round(r.dice, 12)) for r in frame.collect())


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = sorted(brute(map(tuple, docs)))
    assert expected and rows(op2_licences(spark, sf_dir)) == expected


def test_odd_rows(spark):
    mit = licences.NOTICES[5][1]
    docs = [
        (1, mit.upper().replace(" ", "  \t")),
        (2, mit.replace("Permission", "Allowance")),
        (3, mit[:120]),
        (4, None),
        (5, ""),
        (6, "\n\n"),
        (7, "mit"),
        (8, "Released\nunder the\nMIT License."),
        (9, "x\n" * 50_000 + "Released under the MIT License.\n" + "y " * 200_000),
        (10, "the the the the the the the the"),
        (11, "Released under the MIT License. Released under the MIT License."),
    ]
    frame = spark.createDataFrame([(*d, "x", 7) for d in docs], "doc_id long, text string, licence string, line int")
    assert rows(licences.scan(frame)) == sorted(brute(docs))
    assert {r[0] for r in rows(licences.scan(frame))} >= {1, 2, 8, 9}
    twice = frame.union(frame)
    assert rows(licences.scan(twice)) == sorted(brute(docs))
    none = frame.filter("doc_id = -1")
    assert licences.scan(none).count() == 0
    no_words = spark.createDataFrame([(0, "X", "one")], "template int, licence string, text string")
    assert licences.scan(frame, no_words).count() == 0
    no_id = frame.filter("doc_id = 1").selectExpr("cast(null as long) as doc_id", "text")
    assert [r.line for r in licences.scan(no_id).collect()] == [1]


def brute_windows(docs, notices=None):
    out = []
    for doc, text in docs:
        words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
        pairs, best = list(zip(words, words[1:], strict=False)), {}
        for i, (name, other) in enumerate(notices or licences.NOTICES):
            own = bag(other)
            size = own.total()
            for at, pair in enumerate(pairs):
                if pair in own:
                    dice = (own & Counter(pairs[at : at + size])).total() / size
                    if dice >= 0.8:
                        best[name] = min(best.get(name, (0,)), (-dice, i, at))
        out += [(doc, name, i, at, round(-dice, 12)) for name, (dice, i, at) in best.items()]
    return sorted(out)


def window_rows(frame):
    return sorted((r.doc_id, r.licence, r.template, r.first_word, round(r.dice, 12)) for r in frame.collect())


def test_windows_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = brute_windows(map(tuple, docs))
    assert expected and window_rows(op2_licence_windows(spark, sf_dir)) == expected


def test_wrapped_notices_inside_longer_texts(spark):
    rng = random.Random(1)
    other = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    docs, texts = [], dict(enumerate(licences.NOTICES))
    for number, (_, notice) in texts.items():
        wrapped = "\n * ".join(textwrap.wrap(notice, 40))
        docs.append((number, f"{other(number * 7)}\n/*\n * {wrapped}\n */\n{other(90)}"))
        docs.append((100 + number, f"{other(30)} {notice.upper()} {other(30)}"))
        words = notice.split()
        docs.append((200 + number, other(9) + " " + " ".join(w for i, w in enumerate(words) if i % 9 != 4) + " " + other(70)))
    expected = brute_windows(docs)
    assert {(d, n) for d, n, *_ in expected} >= {(d + i, texts[i][0]) for i in texts for d in (0, 100)}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert window_rows(licences.windows(frame)) == expected


def test_windows_of_odd_rows(spark):
    mit = licences.NOTICES[5][1]
    repeated = [("A", "x y x y x y z"), ("B", "x y x y"), ("B", "x y x y"), ("C", "one")]
    docs = [(1, mit), (2, None), (3, ""), (4, "mit"), (5, mit + " " + mit), (6, "x\n" * 50_000 + mit + " y" * 200_000)]
    docs += [(7, "the " * 40), (8, mit[: len(mit) * 9 // 10]), (9, "x y " * 30), (10, "x y x y x y z")]
    frame = spark.createDataFrame([(*d, "x", 7) for d in docs], "doc_id long, text string, licence string, size int")
    assert window_rows(licences.windows(frame)) == brute_windows(docs)
    assert window_rows(licences.windows(frame.union(frame))) == brute_windows(docs)
    own = spark.createDataFrame([(i, *t, 3) for i, t in enumerate(repeated)], "template int, licence string, text string, cell int")
    found = window_rows(licences.windows(frame, own))
    assert found == brute_windows(docs, repeated) and {9, 10} <= {r[0] for r in found}
    assert licences.windows(frame.filter("doc_id = -1")).count() == 0
    assert licences.windows(frame, own.filter("licence = 'C'")).count() == 0
    no_id = frame.filter("doc_id = 1").selectExpr("cast(null as long) as doc_id", "text")
    assert [r.licence for r in licences.windows(no_id).collect()] == ["MIT"]
