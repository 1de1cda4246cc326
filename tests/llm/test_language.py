"""Language identification: held-out accuracy and odd rows."""

import zlib

from oreline.llm import language
from oreline.llm.queries import op10_language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = op10_language(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    again = {tuple(r) for r in op10_language(spark, "/root/testdata/sf0.01").collect()}
    assert again == {tuple(r) for r in rows}


def test_clean_documents_are_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    assert language.accepted(docs, model).count() >= 0.995 * docs.count()


SCRIPTS = [
    "今天天气很好，我们去公园散步吧。春天来了，花都开了。",
    "今日はいい天気ですね。公園へ行きましょう。桜が咲いています。",
    "сегодня хорошая погода, пойдем гулять в парк",
    "الطقس جميل اليوم دعنا نذهب إلى الحديقة",
    "ο καιρός είναι καλός σήμερα πάμε στο πάρκο",
    "วันนี้อากาศดีเราไปเดินเล่นที่สวนสาธารณะกันเถอะ",
    "xqzvk wqpzx kjvbq zxwvq pkqjz vvkxj qzzkw",
    "\U00032010\U00032011\U00032012",
]


def test_scripts_never_seen_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    texts = [" ".join([text] * times) for text in SCRIPTS for times in (1, 3, 30)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = language.identify(frame, model).collect()
    assert all(r.rejected and 0 <= r.score <= 1 for r in rows)
    # letters of every plane are letters
    assert all(r.lang_pred != "und" for r in rows)
    assert language.accepted(frame, model).count() == 0


def test_languages_left_out_are_rejected_and_known_ones_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    langs = sorted(r[0] for r in docs.select("lang").distinct().collect() if r[0])
    assert len(langs) == 4
    for left_out in langs:
        known, unknown = docs.filter(docs.lang != left_out), docs.filter(docs.lang == left_out)
        model = language.train(known)
        rejected = 1 - language.accepted(unknown, model).count() / unknown.count()
        kept = language.accepted(known, model).count() / known.count()
        assert rejected >= 0.95 and kept >= 0.995, (left_out, rejected, kept)


def test_odd_rows(spark):
    train = [(i, "das ist ein haus und", "de", "x") for i in range(40)]
    train += [(100 + i, "this is the house and", "en", None) for i in range(40)]
    odd = [
        (900, None, "de", "x"),
        (901, "", "en", "x"),
        (902, "12 34 %%% \n", None, "x"),
        (903, "the house " * 100_000, None, "x"),
        (903, "the house", None, "x"),
        (None, "das haus", "de", "x"),
        (904, "\U0001f600 haus und", None, "x"),
    ]
    frame = spark.createDataFrame(train + odd, "doc_id long, text string, lang string, score string")
    model = language.train(frame)
    rows = language.identify(frame, model).collect()
    assert len(rows) == len(train) + len(odd)
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append((r.lang_pred, r.score, r.rejected))
    assert found[900] == found[901] == found[902] == [("und", 0.0, True)]
    assert [x[0] for x in found[903]] == ["en", "en"]
    assert found[None][0][0] == found[904][0][0] == "de"
    kept = language.accepted(frame, model)
    assert kept.columns == frame.columns and kept.count() == len(train) + 4
    empty = frame.filter("doc_id = -1")
    assert language.identify(empty, model).count() == 0
    nothing = language.train(empty)
    assert {r.lang_pred for r in language.identify(frame, nothing).collect()} == {"und"}
    one = language.train(frame.filter("lang = 'de'"))
    assert {r.lang_pred for r in language.identify(frame, one).collect()} == {"und", "de"}


def test_pieces_do_not_change_the_counts(monkeypatch):
    text = "Straße über, école — 12 пять " * 50
    whole, letters = language.bucket_counts(text)
    monkeypatch.setattr(language, "PIECE", 400)
    parts, same = language.bucket_counts(text)
    assert letters == same
    assert abs(whole - parts).sum() < 0.05 * whole.sum()  # runs across the blanks between pieces
    monkeypatch.setattr(language, "PIECE", 7)
    assert language.bucket_counts("x" * 100)[1] == 100
