"""The pipeline stage by stage against brute-force versions, and as a whole."""

import zlib
from collections import Counter

import corpus_pipeline
from oreline.llm import decontaminate, language, mixing
from tests.llm.test_decontaminate import planted_pairs
from tests.llm.test_simhash import brute_components, brute_print

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_what_they_should(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "benchmark", "mixing", "sharding"]

    model = language.train(docs)
    known = stages["language"](spark, docs, folder).cache()
    expected = {r.doc_id for r in language.identify(docs, model).collect() if not r.rejected}
    assert {r.doc_id for r in known.collect()} == expected and known.columns == COLUMNS

    rows = [(r.doc_id, brute_print(r.text)) for r in known.collect()]
    first = {d for d, _, c in brute_components(rows) if d == c}
    single = stages["near_duplicates"](spark, known, folder).cache()
    assert sorted(r.doc_id for r in single.collect()) == sorted(first) and single.columns == COLUMNS
    before = {r.doc_id: tuple(r) for r in docs.collect()}
    assert all(tuple(r) == before[r.doc_id] for r in single.collect())

    clean = stages["benchmark"](spark, single, folder).cache()
    found = {r.doc_id for r in decontaminate.contaminated(single, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    kept = {r.doc_id for r in clean.collect()}
    assert kept == first - found and clean.columns == COLUMNS
    assert not kept & {d for d, _ in planted_pairs(single.collect(), items)}

    mixed = stages["mixing"](spark, clean, folder).cache()
    assert mixed.columns == COLUMNS
    _, plan = mixing.mix(clean)
    taken = {r.doc_id: r.taken for r in plan.collect()}
    words, text = Counter(), {r.doc_id: r.text for r in clean.collect()}
    for r in mixed.collect():
        own = r.text.split()
        words[r.doc_id] += len(own)
        assert r.text == text[r.doc_id] or own == text[r.doc_id].split()[: len(own)]
        assert r.n_chars == len(r.text)
    assert words == Counter({d: n for d, n in taken.items() if n})

    shards = stages["sharding"](spark, mixed, folder).collect()
    assert sorted(r.doc_id for r in shards) == sorted(r.doc_id for r in mixed.collect())
    sizes = Counter(r.shard for r in shards)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert Counter((r.doc_id, r.text_crc32) for r in shards) == Counter(
        (r.doc_id, zlib.crc32(r.text.encode())) for r in mixed.collect()
    )


def test_run_equals_the_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)


def test_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [
        (None, None, None, None, None),
        (-1, "", "en", "src1", 0),
        (-2, "%%%", None, None, 3),
        (None, "the of and to in is", None, None, None),
        (-3, "the and " * 50_000, "en", None, None),
        (-3, "the and " * 50_000, "en", None, None),
    ]
    frame = docs.union(spark.createDataFrame(odd, docs.schema)).withColumn("_text", docs["source"])
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, sf_dir)
        if name != "sharding":
            assert frame.columns == [*COLUMNS, "_text"]
    assert frame.count() > 0
    empty = docs.filter("doc_id = -9")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.count() == 0
