"""Queries of the operators that SQL can express, against an independent engine."""

import glob
import os

import duckdb
import pytest

from oreline.llm.queries import ORACLES, QUERIES


def normal(value):
    return f"{value:.9g}" if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf_dir, name):
    other = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        table = os.path.basename(path).removesuffix(".parquet")
        other.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, sf_dir)
    result = other.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted((tuple(map(normal, r)) for r in result.fetchall()), key=repr)
    got = [tuple(normal(r[c]) for c in columns) for r in df.collect()]
    assert sorted(got, key=repr) == expected
    other.close()
