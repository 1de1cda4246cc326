"""Near-duplicate lines against a brute-force version, and odd rows."""

import random

from oreline.llm import lines
from oreline.llm.queries import op3_line_dedup


def within_one(a, b):
    """Whether word sequences differ by one word changed, added or removed, or are equal."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute(docs):
    first, places = {}, []
    for doc, text in docs:
        if doc is None or text is None:
            continue
        for number, line in enumerate(text.split("\n"), 1):
            words = tuple(line.translate(str.maketrans("\t\x0b\f\r", "    ")).split(" "))
            words = tuple(w for w in words if w)
            if words:
                places.append((doc, number, words))
                first[words] = min((doc, number), first.get(words, (doc, number)))
    earliest = {w: min(p for u, p in first.items() if within_one(w, u)) for w in first}
    return sorted(
        {
            (d, n, *earliest[w], int(earliest[w] != first[w]))
            for d, n, w in places
            if (d, n) != earliest[w]
        }
    )


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = brute(map(tuple, docs))
    assert {r[4] for r in expected} == {0, 1}
    assert rows(op3_line_dedup(spark, sf_dir)) == expected


def test_random_edits(spark):
    rng = random.Random(5)
    docs = []
    for i in range(150):
        text = []
        for _ in range(rng.randint(0, 4)):
            n = rng.choice([1, 2, 3, 4, 5, 6, 12, 13])
            words = [f"w{j}" for j in range(n)]
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(words) + 1)
                kind = rng.randrange(3)
                if kind == 0:
                    words.insert(at, rng.choice("abc"))
                elif words[at:]:
                    words[at : at + 1] = [rng.choice("abc")] if kind == 1 else []
            text.append(" ".join(words))
        docs.append((i, "\n".join(text)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(lines.duplicates(frame)) == brute(docs)


def test_odd_rows(spark):
    docs = [
        (1, None),
        (2, ""),
        (3, "\n \t\n"),
        (4, "a b c d"),
        (5, "a  b\tc d\r\nx"),
        (6, "a b c d e\nq"),
        (7, "y " * 3000 + "\n" + "y " * 3001),
        (7, "y " * 3000 + "\nelse"),
        (8, "\n".join(f"page number {i} of the book" for i in range(3000))),
        (None, "a b c d"),
    ]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, first string, line_no int")
    assert rows(lines.duplicates(frame)) == brute(docs[:8]) + [
        (8, n, 8, 1, 1) for n in range(2, 3001)
    ]
    assert rows(lines.duplicates(frame.filter("doc_id = 0"))) == []
    clean = {(r.doc_id, r.text) for r in lines.without_duplicates(frame).collect()}
    assert {(1, None), (2, ""), (None, "a b c d"), (4, "a b c d"), (8, "page number 0 of the book")} <= clean
    assert (5, "x") in clean
    assert lines.without_duplicates(frame).columns == frame.columns


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_classes(docs):
    places = [
        ((doc, number), tuple(line.split()))
        for doc, text in docs
        for number, line in enumerate(text.split("\n"), 1)
        if line.split()
    ]
    first, copies = {}, {}
    for place, words in sorted(places):
        first.setdefault(words, place)
        copies[words] = copies.get(words, 0) + 1
    near = {w: set() for w in first}
    for a in first:
        for b in first:
            n = min(len(a), len(b))
            most = 0 if n < 4 else max(1, n // 20)
            if a != b and abs(len(a) - len(b)) <= most and edits(a, b) <= most:
                near[a].add(b)
    stays, root = set(), {}
    for words in sorted(first, key=first.get):
        if not near[words] & stays:
            stays.add(words)
        if words not in root:
            front = [words]
            while front:
                w = front.pop()
                if w not in root:
                    root[w] = first[words]
                    front += near[w]
    return sorted(
        (*place, *root[w], len(near[w]), place == first[w] and w in stays)
        for place, w in places
        if near[w] or copies[w] > 1
    )


def test_classes_hold_every_link(spark):
    rng = random.Random(8)
    docs = [(1, "a b c d"), (2, "a x c y"), (3, "a b c y"), (4, "Introduction\n}\nx x x x"), (5, "Summary\nelse\nx x x x x")]
    docs += [(6, "Chapter 1"), (7, "Chapter\n}"), (8, "x y x x x\nx x x x")]
    base = {n: [f"w{j % 31}" for j in range(n)] for n in (3, 4, 5, 12, 19, 39, 40, 41, 61, 62, 130)}
    for i in range(120):
        text = []
        for _ in range(rng.randint(1, 3)):
            words = list(base[rng.choice(sorted(base))])
            for _ in range(rng.randint(0, 2 + len(words) // 30)):
                at, kind = rng.randrange(len(words)), rng.randrange(3)
                words[at : at + (kind > 0)] = [rng.choice("abc")] if kind < 2 else []
            text.append(" ".join(words))
        docs.append((100 + i, "\n".join(text)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = rows(lines.classes(frame))
    assert found == brute_classes(docs)
    assert (2, 1, 1, 1, 1, True) in found and (3, 1, 1, 1, 2, False) in found
    clean = {r.doc_id: r.text for r in lines.without_duplicates(frame).collect()}
    assert clean[4] == "Introduction\n}\nx x x x" and clean[5].startswith("Summary\nelse") and clean[7] == "Chapter"


def test_long_lines_of_two_changed_words_are_one_class(spark):
    words = [f"w{i}" for i in range(40)]
    other = ["x" if i in (9, 30) else w for i, w in enumerate(words)]
    third = ["x" if i in (9, 20, 30) else w for i, w in enumerate(words)]
    docs = [(i, " ".join(w)) for i, w in enumerate((words, other, third))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(lines.classes(frame)) == [(0, 1, 0, 1, 1, True), (1, 1, 0, 1, 2, False), (2, 1, 0, 1, 1, True)]
