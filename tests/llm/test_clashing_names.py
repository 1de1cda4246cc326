"""Extra columns, whatever their names, come through the filtering and mixing operators unchanged."""

import re

import pytest

from oreline.llm import lines, mixing, simhash

DOCS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta\nthe same long line of eight words here", "a"),
    (2, "alpha beta gamma delta epsilon zeta eta theta\nthe same long line of eight words here", "a"),
    (3, "quite another text about rivers and hills and woods", "b"),
    (4, "one more text that nobody has seen so far anywhere", "b"),
]


def _names(module):
    """Every name that the module's code makes a column of, and some more."""
    code = open(module.__file__).read()
    found = set(re.findall(r'"(_?[a-z][a-z_]*)"', code)) | {"row", "id", "gone", "number", "order", "hash"}
    return sorted(found - {"doc_id", "text", "source", "n_chars", "lang"})


@pytest.mark.parametrize(
    "module, operator",
    [(mixing, mixing.mixed_documents), (simhash, simhash.keep_one), (lines, lines.without_duplicates)],
)
def test_extra_columns_are_kept(spark, module, operator):
    names = _names(module)
    rows = [(*r, *[f"{name}-{r[0]}" for name in names]) for r in DOCS]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    out = operator(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert got
    for row in got:
        assert [row[name] for name in names] == [f"{name}-{row['doc_id']}" for name in names]
