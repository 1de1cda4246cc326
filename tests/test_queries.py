"""Every registered query against an independent engine on the same tables."""

import glob
import os

import duckdb
import pytest
from helpers import bag

import __spark_entry__ as entry_points

OPTIONAL = set(entry_points.llm_queries.QUERIES) | {"pipeline"} if entry_points.llm_queries else set()
QUERIES = {k: q for k, q in entry_points.queries().items() if k not in OPTIONAL}
ORACLES = {k: s for k, s in entry_points.oracle_sql().items() if k not in OPTIONAL}


@pytest.fixture(scope="module")
def other_engine(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    yield connection
    connection.close()


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, sf_dir, other_engine, name):
    df = QUERIES[name](spark, sf_dir)
    result = other_engine.execute(ORACLES[name])
    expected = bag([d[0] for d in result.description], result.fetchall())
    assert bag(df.columns, df.collect()) == expected


def test_flagship(spark):
    rows = entry_points.entry(spark).collect()
    assert rows[0]["country"] == "United States" and rows[0]["sales_amount"] == 95924477


@pytest.mark.parametrize("name", ["silver_crm_sales", "silver_erp_cust", "silver_erp_loc"])
def test_row_wise_cleansing_has_no_window_and_no_python(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Window" not in plan and "Python" not in plan and "CartesianProduct" not in plan


def test_cleansing_of_stored_sales_does_not_shuffle(spark, sf_dir, tmp_path):
    from oreline.plans.silver import crm_sales_details
    from oreline.sources.samples import EXTRACTS

    EXTRACTS["crm_sales_details"](spark, sf_dir).write.parquet(str(tmp_path / "s"))
    plan = crm_sales_details(spark.read.parquet(str(tmp_path / "s")))._jdf.queryExecution()
    assert "Exchange" not in plan.executedPlan().toString()


def test_unused_columns_are_not_read(spark, sf_dir, tmp_path):
    from oreline.plans import quality
    from oreline.plans.silver import crm_sales_details
    from oreline.sources.samples import EXTRACTS

    EXTRACTS["crm_sales_details"](spark, sf_dir).write.parquet(str(tmp_path / "s"))
    stored = crm_sales_details(spark.read.parquet(str(tmp_path / "s")))
    plan = quality.date_order(stored)._jdf.queryExecution().executedPlan().toString()
    assert (
        "ReadSchema: struct<sls_order_dt:string,sls_ship_dt:string,sls_due_dt:string>" in plan
    )


def test_cleansing_stays_small_enough_to_be_compiled(spark, sf_dir, tmp_path):
    """The JVM interprets methods above 8000 bytes for ever, which costs several times the run time."""
    from oreline.plans.silver import silver_builders
    from oreline.sources.samples import EXTRACTS

    for table, build in silver_builders().items():
        path = str(tmp_path / table)
        EXTRACTS[table](spark, sf_dir).write.parquet(path)
        df = build(spark.read.parquet(path))
        stages = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(
            df._jdf.queryExecution().executedPlan()
        )
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
        assert max(sizes, default=0) < 8000, table
