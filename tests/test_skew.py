"""A third of the rows under one key: results stay whole, and the hot group is split."""

import random
from collections import Counter
from datetime import date, timedelta

import pytest
from helpers import frame_bag
from pyspark.sql import functions as F

from oreline.plans import gold
from oreline.plans.silver import crm_cust_info

SMALL_PIECES = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "30k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def small_pieces(spark):
    """Shuffle joins only, with thresholds at which test data counts as skewed."""
    before = {k: spark.conf.get(k, None) for k in SMALL_PIECES}
    for name, value in SMALL_PIECES.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _run(df):
    """Rows as read back, and the plan after run-time optimisation."""
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def _sales(spark, n):
    hot = F.col("id") % 3 == 0
    return spark.range(0, n, 1, 12).select(
        F.concat(F.lit("SO"), F.col("id")).alias("sls_ord_num"),
        F.when(hot, "P1").otherwise(F.concat(F.lit("P"), F.col("id") % 97)).alias("sls_prd_key"),
        F.when(hot, "C1").otherwise(F.concat(F.lit("C"), F.col("id") % 501)).alias("sls_cust_id"),
        *[F.lit(date(2024, 1, 1)).alias(f"sls_{c}_dt") for c in ("order", "ship", "due")],
        F.lit(6.0).alias("sls_sales"),
        F.lit(2.0).alias("sls_quantity"),
        F.lit(3.0).alias("sls_price"),
    )


def test_hot_sales_keys_are_split(spark, small_pieces):
    sales = _sales(spark, 60_000)
    products = spark.range(90).select(
        F.col("id").alias("product_key"), F.concat(F.lit("P"), "id").alias("product_number")
    )
    customers = spark.range(480).select(
        F.col("id").alias("customer_key"), F.concat(F.lit("C"), "id").alias("customer_id")
    )
    shuffled = gold.fact_sales(sales, products, customers, broadcast_bytes=0)
    rows, plan = _run(shuffled)
    assert "SortMergeJoin(skew=true)" in plan and "Broadcast" not in plan
    expected = gold.fact_sales(sales, products, customers)
    assert Counter(rows) == Counter(expected.collect())
    assert len(rows) == 60_000


def _silver_customers(spark, n):
    blank = F.col("id") % 3 == 0
    return spark.range(0, n, 1, 8).select(
        F.col("id").cast("string").alias("cst_id"),
        F.when(blank, "").otherwise(F.concat(F.lit("AW"), "id")).alias("cst_key"),
        F.repeat(F.lit("first"), 5).alias("cst_firstname"),
        F.sha2(F.col("id").cast("string"), 256).alias("cst_lastname"),
        F.lit("Single").alias("cst_marital_status"),
        F.lit("n/a").alias("cst_gndr"),
        F.lit(date(2024, 1, 1)).alias("cst_create_date"),
    )


def test_hot_customer_key_is_split_in_both_joins(spark, small_pieces):
    customers = _silver_customers(spark, 20_000)
    numbers = spark.range(0, 20_000, 2)
    people = numbers.select(
        F.concat(F.lit("AW"), "id").alias("cid"),
        F.lit(date(1980, 1, 1)).alias("bdate"),
        F.lit("Male").alias("gen"),
    )
    places = numbers.select(F.concat(F.lit("AW"), "id").alias("cid"), F.lit("France").alias("cntry"))
    rows, plan = _run(gold.customer_rows(customers, people, places))
    assert plan.count("SortMergeJoin(skew=true)") >= 2
    assert len(rows) == 20_000
    known = [r for r in rows if r["country"] == "France"]
    assert {r["customer_id"] for r in known} == {str(i) for i in range(0, 20_000, 2) if i % 3}


def _brute_force_customers(customers, people, places):
    """Left joins with every match, in customer id order."""
    joined = []
    for c in customers:
        for p in [p for p in people if p[0] == c[1]] or [(None, None, None)]:
            for q in [q for q in places if q[0] == c[1]] or [(None, None)]:
                gender = c[5] if c[5] != "n/a" else p[2] or "n/a"
                joined.append((c[0], c[1], c[2], c[3], q[1], c[4], gender, p[1], c[6]))
    return joined


@pytest.mark.parametrize("seed", range(2))
def test_repeated_erp_rows_multiply_customers(spark, seed):
    pick = random.Random(seed)
    customers = [
        (str(i), "" if i % 3 == 0 else f"AW{i}", f"f{i}", "l", "Single", pick.choice(["Male", "n/a"]),
         date(2024, 1, 1))
        for i in range(12)
    ]
    people = [("AW1", date(1980, 1, 1), "Female")] * 40 + [
        (pick.choice(["AW2", "AW4", "AWx"]), pick.choice([None, date(1970, 5, 5)]), "n/a")
        for _ in range(20)
    ]
    places = [("AW1", "France")] * 5 + [("AW1", "Spain"), ("AW5", "n/a"), ("", "Blank")]
    silver = {
        "crm_cust_info": spark.createDataFrame(
            customers,
            "cst_id string, cst_key string, cst_firstname string, cst_lastname string,"
            " cst_marital_status string, cst_gndr string, cst_create_date date",
        ),
        "erp_cust_az12": spark.createDataFrame(people, "cid string, bdate date, gen string"),
        "erp_loc_a101": spark.createDataFrame(places, "cid string, cntry string"),
    }
    got = gold.dim_customers(silver).collect()
    expected = _brute_force_customers(customers, people, places)
    assert Counter(tuple(r)[1:] for r in got) == Counter(expected)
    assert sorted(r["customer_key"] for r in got) == list(range(1, len(expected) + 1))
    in_key_order = [r["customer_id"] for r in sorted(got, key=lambda r: r["customer_key"])]
    assert in_key_order == sorted(in_key_order)


def test_repeated_products_and_categories(spark):
    products = [("10", "K1", "n", 1.0, "Road", None, None, "AC_HE")] * 30 + [
        ("11", "K2", "m", 2.0, "Road", date(2020, 1, 1), None, "AC_HE"),
        ("12", "K2", "old", 2.0, "Road", date(2019, 1, 1), date(2019, 12, 31), "AC_HE"),
        ("13", "K3", "o", 3.0, "n/a", date(2020, 1, 1), None, "ZZ_ZZ"),
    ]
    categories = [("AC_HE", "Accessories", "Helmets", "Yes")] * 2 + [("AC_HE", "A", "B", "No")]
    silver = {
        "crm_prd_info": spark.createDataFrame(
            products,
            "prd_id string, prd_key string, prd_nm string, prd_cost double, prd_line string,"
            " prd_start_dt date, prd_end_dt date, cat_id string",
        ),
        "erp_px_cat_g1v2": spark.createDataFrame(
            categories, "id string, cat string, subcat string, maintenance string"
        ),
    }
    got = sorted(gold.dim_products(silver).collect())
    assert [r["product_key"] for r in got] == list(range(1, 95))
    assert [r["product_number"] for r in got] == ["K2"] * 3 + ["K3"] + ["K1"] * 90
    assert Counter(r["category"] for r in got) == {"Accessories": 62, "A": 31, None: 1}


def test_hot_customer_id_keeps_its_latest_event(spark):
    events = spark.range(0, 30_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "1").otherwise(F.col("id").cast("string")).alias("cst_id"),
        F.lit("AW").alias("cst_key"),
        F.col("id").cast("string").alias("cst_firstname"),
        F.lit(" x ").alias("cst_lastname"),
        F.lit("s").alias("cst_marital_status"),
        F.lit("m").alias("cst_gndr"),
        F.date_add(F.lit(date(2000, 1, 1)), (F.col("id") % 9001).cast("int"))
        .cast("string")
        .alias("cst_create_date"),
    )
    rows = crm_cust_info(events).collect()
    assert len(rows) == 20_000
    hot = [r for r in rows if r["cst_id"] == "1"]
    assert len(hot) == 1
    latest = max(i % 9001 for i in range(0, 30_000, 3))
    assert hot[0]["cst_create_date"] == date(2000, 1, 1) + timedelta(days=latest)


def test_orphans_with_every_row_under_one_key(spark):
    from oreline.operators.lookup import orphan_count

    rows = spark.range(0, 50_000, 1, 8).select(F.lit("x").alias("k"))
    nobody = spark.createDataFrame([], "id string")
    assert frame_bag(orphan_count(rows, "k", nobody, "id"))[1] == [(50_000, 50_000)]
