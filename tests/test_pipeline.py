import os
from datetime import date

import pytest
from helpers import frame_bag, normal
from pyspark.sql import functions as F

from oreline.operators import conform
from oreline.plans import gold, pipeline, profiling, quality, reports, views
from oreline.schemas import GOLD_CONTRACT, LOAD_STAMP, SOURCE_TABLES, SOURCES
from oreline.sources.csv import write_csv
from oreline.sources.samples import EXTRACTS
from oreline.sources.tables import Warehouse

# Row counts and check results agreed for the smallest test tables.
BRONZE = {
    "crm_cust_info": 180,
    "crm_prd_info": 399,
    "crm_sales_details": 6000,
    "erp_cust_az12": 139,
    "erp_loc_a101": 142,
    "erp_px_cat_g1v2": 58,
}
SILVER = {**BRONZE, "crm_cust_info": 149}
GOLD = {"dim_customers": 149, "dim_products": 200, "fact_sales": 6000}


@pytest.fixture(scope="module")
def landing(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("landing")
    for source in SOURCES:
        write_csv(EXTRACTS[source.table](spark, sf_dir), str(folder / source.file))
    return str(folder)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return str(tmp_path_factory.mktemp("tables"))


@pytest.fixture(scope="module")
def loaded(spark, landing, root):
    report = pipeline.run_pipeline(spark, landing, root, as_of=date(2026, 1, 1))
    return Warehouse(spark, root), report


def test_rows_per_layer(loaded):
    assert loaded[1].rows == {"bronze": BRONZE, "silver": SILVER, "gold": GOLD}


def test_layers_exist(loaded):
    names = {row[0] for row in loaded[0].list_layers().collect()}
    assert {"bronze", "silver", "gold"} <= names


def test_bronze_is_text_without_nulls(loaded):
    for source in SOURCES:
        df = loaded[0].read("bronze", source.table)
        assert tuple(df.columns) == source.columns
        assert {f.dataType.simpleString() for f in df.schema} == {"string"}
        assert df.agg(*[F.count_if(F.col(c).isNull()) for c in df.columns]).first()[0] == 0


def test_silver_ends_with_the_load_time(loaded):
    for table in SOURCE_TABLES:
        df = loaded[0].read("silver", table)
        assert df.columns[-1] == LOAD_STAMP
        assert df.select(LOAD_STAMP).distinct().count() == 1


def test_gold_follows_the_contract(loaded):
    for table, contract in GOLD_CONTRACT.items():
        df = loaded[0].read("gold", table)
        assert [(f.name, f.dataType) for f in df.schema] == [
            (f.name, f.dataType) for f in contract
        ]


def test_surrogate_keys_are_dense(loaded):
    for table, key in (("dim_customers", "customer_key"), ("dim_products", "product_key")):
        row = loaded[0].read("gold", table).agg(
            F.min(key), F.max(key), F.count_distinct(key)
        ).first()
        assert tuple(row) == (1, GOLD[table], GOLD[table])


def test_reconcile(loaded, landing):
    for folder in (None, landing):
        rows = pipeline.reconcile(loaded[0], folder).collect()
        assert {r["table"]: (r["source_rows"], r["loaded_rows"], r["difference"]) for r in rows} == {
            table: (n, n, 0) for table, n in BRONZE.items()
        }
    plan = pipeline.reconcile(loaded[0])._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "csv" not in plan.lower()


def test_profiles(loaded):
    rows = profiling.profile_all(loaded[0].bronze_tables()).collect()
    counts = {(r["table"], r["metric"]): r["n"] for r in rows if r["value"] is None}
    expected = {
        ("crm_cust_info", "duplicate_cst_id"): 30,
        ("crm_cust_info", "blank_cst_id"): 1,
        ("crm_prd_info", "missing_cost"): 37,
        ("crm_sales_details", "zero_order_date"): 116,
        ("crm_sales_details", "amount_mismatch"): 2374,
        ("crm_sales_details", "bad_price"): 1490,
        ("erp_cust_az12", "nas_prefix"): 46,
        ("erp_cust_az12", "future_bdate"): 2,
        ("erp_px_cat_g1v2", "null_id"): 0,
    }
    assert {k: counts[k] for k in expected} == expected


def test_quality_report(loaded):
    rows = {r["rule"]: r for r in pipeline.validate(loaded[0]).collect()}
    assert {rule: r["violations"] for rule, r in rows.items()} == {
        "duplicate_cst_id": 0,
        "duplicate_prd_key": 199,
        "several_current_versions": 0,
        "unapproved_value": 0,
        "order_after_ship_or_due": 129,
        "amount_mismatch": 577,
        "bad_amount_or_factor": 577,
        "orphan_customer": 17,
        "orphan_product": 23,
        "fact_rows_differ": 0,
        "missing_surrogate_key": 40,
        "gold_amount_mismatch": 577,
    }
    assert rows["duplicate_prd_key"]["status"] == "info"
    assert rows["unapproved_value"]["status"] == "ok"
    assert rows["orphan_product"]["status"] == "failed"
    assert rows["orphan_product"]["checked"] == 6000


def test_sales_by_country(loaded):
    fact, customers = (loaded[0].read("gold", t) for t in ("fact_sales", "dim_customers"))
    rows = reports.sales_by_country(fact, customers).collect()
    assert rows[0]["country"] == "United States" and rows[0]["sales_amount"] == 95924477
    amounts = [r["sales_amount"] for r in rows]
    assert amounts == sorted(amounts, reverse=True)
    assert fact.agg(F.sum("sales_amount")).first()[0] == 302218551


def test_preview(loaded):
    rows = loaded[0].preview("gold", "dim_customers", "customer_key").collect()
    assert [r["customer_key"] for r in rows] == list(range(1, 11))


def test_fact_is_the_same_without_broadcast(loaded, spark):
    warehouse = loaded[0]
    sales, products, customers = (
        warehouse.read("silver", "crm_sales_details"),
        warehouse.read("gold", "dim_products"),
        warehouse.read("gold", "dim_customers"),
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = gold.fact_sales(sales, products, customers, broadcast_bytes=0)
        assert "BroadcastHashJoin" not in shuffled._jdf.queryExecution().toString()
        got = frame_bag(shuffled)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert got == frame_bag(warehouse.read("gold", "fact_sales"))


def test_mismatched_fact_is_refused(loaded):
    sales = loaded[0].read("silver", "crm_sales_details")
    fact = loaded[0].read("gold", "fact_sales")
    quality.require_row_per_line(sales, fact)
    with pytest.raises(quality.RowCountMismatch):
        quality.require_row_per_line(sales, fact.limit(5999))


def test_loading_again_changes_nothing(loaded, spark, landing, root):
    warehouse = loaded[0]
    before = {t: frame_bag(warehouse.read("gold", t)) for t in GOLD}
    report = pipeline.run_pipeline(spark, landing, root, as_of=date(2026, 1, 1))
    assert report.rows["gold"] == GOLD
    assert {t: frame_bag(warehouse.read("gold", t)) for t in GOLD} == before


def test_views_equal_tables_and_follow_silver(loaded, spark, landing, root):
    warehouse = loaded[0]
    tables = {t: frame_bag(warehouse.read("gold", t)) for t in GOLD}
    schemas = {t: [normal(f.dataType.simpleString()) for f in warehouse.read("gold", t).schema]
               for t in GOLD}
    for bucket_rows in (1_000_000, 20):
        views.create_gold_views(warehouse, bucket_rows)
        assert {t: frame_bag(warehouse.read("gold", t)) for t in GOLD} == tables
    assert schemas == {
        t: [f.dataType.simpleString() for f in warehouse.read("gold", t).schema] for t in GOLD
    }

    fewer = spark.createDataFrame(
        warehouse.read("silver", "erp_loc_a101").limit(50).collect(),
        warehouse.read("silver", "erp_loc_a101").schema,
    )
    warehouse.load(fewer, "silver", "erp_loc_a101")
    known = warehouse.read("gold", "dim_customers").filter("country is not null").count()
    assert known <= 50

    assert pipeline.run_pipeline(spark, landing, root, as_of=date(2026, 1, 1)).rows["gold"] == GOLD
    assert {t: frame_bag(warehouse.read("gold", t)) for t in GOLD} == tables


def test_view_mode(spark, landing, root, loaded):
    report = pipeline.run_pipeline(spark, landing, root, materialize="view")
    assert "gold" not in report.rows
    assert loaded[0].read("gold", "fact_sales").count() == GOLD["fact_sales"]
    assert pipeline.run_pipeline(spark, landing, root).rows["gold"] == GOLD


def _bucket_sizes(spark, df, cuts, order):
    """Rows in each bucket, in the order of the buckets."""
    df.createOrReplaceTempView("rows_to_cut")
    cuts.createOrReplaceTempView("cuts_of_rows")
    sql = f"WITH {views.bucket_sql('rows_to_cut', 'cuts_of_rows', order)} SELECT bucket, count(*) AS n FROM bucketed GROUP BY 1"
    rows = spark.sql(sql).orderBy("bucket").collect()
    for view in ("rows_to_cut", "cuts_of_rows"):
        spark.catalog.dropTempView(view)
    return [r["n"] for r in rows]


def test_bounds_cut_evenly_whatever_the_keys(spark):
    rows = [("x" * 40 + f"{i:05d}" if i % 4 else None, i % 7) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, v int")
    assert views.bounds(df, ["k", "v"], 4000).count() == 0
    assert _bucket_sizes(spark, df, views.bounds(df, ["k", "v"], 4000), ["k", "v"]) == [4000]
    cuts = views.bounds(df, ["k", "v"], 40)
    stored = spark.createDataFrame(cuts.collect(), cuts.schema)
    sizes = _bucket_sizes(spark, df, stored, ["k", "v"])
    assert sum(sizes) == 4000 and len(sizes) >= 60 and max(sizes) <= 1000 // 7 + 200
    groups = stored.select(F.size("keys").alias("n")).collect()
    # comparisons a row: the groups, and the bounds of the largest one
    assert len(groups) + max(r["n"] for r in groups) <= 2 * round(100**0.5) + 1
    odd = spark.createDataFrame([("it's",), ("back\\slash",), ('"',), ("z",)], "k string")
    cuts = views.bounds(odd, ["k"], 1)
    cuts = spark.createDataFrame(cuts.collect(), cuts.schema)
    assert sum(_bucket_sizes(spark, odd, cuts, ["k"])) == 4
    # No row carries the bounds: they are read once, as values of the query.
    odd.createOrReplaceTempView("rows_to_cut")
    cuts.createOrReplaceTempView("cuts_of_rows")
    plan = spark.sql(f"WITH {views.bucket_sql('rows_to_cut', 'cuts_of_rows', ['k'])} SELECT k, bucket FROM bucketed")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "AS firsts" not in text and "AS groups" not in text and "scalar-subquery" in text
    for view in ("rows_to_cut", "cuts_of_rows"):
        spark.catalog.dropTempView(view)
    none = spark.createDataFrame([], "k string")
    assert views.bounds(none, ["k"]).count() == 0


def test_buckets_stay_even_while_silver_grows(spark, sf_dir, tmp_path):
    """Bounds follow a Silver that has become ten times as large; the view itself is not made again."""
    import __spark_entry__ as entry_points

    layers = entry_points.Layers(spark, sf_dir)
    warehouse = Warehouse(spark, str(tmp_path / "tables"), prefix="grow_")
    warehouse.create_layers()
    for table in ("crm_cust_info", "erp_cust_az12", "erp_loc_a101"):
        warehouse.load(layers.silver[table], "silver", table)
    views.create_gold_views(warehouse, 30, ("dim_customers",))

    def sizes():
        rows = spark.sql(f"WITH {views._customer_parts('grow_silver')} SELECT * FROM joined")
        return _bucket_sizes(spark, rows, warehouse.read("gold", "dim_customers__bounds"), views.CUSTOMER_ORDER)

    assert max(sizes()) <= 60
    customers = warehouse.read("silver", "crm_cust_info")
    grown = customers.crossJoin(spark.range(10)).withColumn("cst_id", F.expr("'9' || cst_id || id")).drop("id")
    warehouse.load(spark.createDataFrame(grown.collect(), grown.schema), "silver", "crm_cust_info")
    assert max(sizes()) > 1000
    assert views.refresh_bounds(warehouse) == ["dim_customers"]
    assert max(sizes()) <= 60 and len(sizes()) >= 40
    keys = [r[0] for r in warehouse.read("gold", "dim_customers").select("customer_key").orderBy("customer_key").collect()]
    assert keys == list(range(1, 1491))
    warehouse.drop_layers()


def test_views_number_a_crowd_of_equal_rows(spark, sf_dir, tmp_path):
    """A third of the locations share a key, and the rows of one customer repeat."""
    import __spark_entry__ as entry_points

    layers = entry_points.Layers(spark, sf_dir)
    warehouse = Warehouse(spark, str(tmp_path / "tables"), prefix="crowd_")
    warehouse.create_layers()
    for table in ("crm_cust_info", "erp_cust_az12", "crm_prd_info", "erp_px_cat_g1v2"):
        warehouse.load(layers.silver[table], "silver", table)
    places = layers.silver["erp_loc_a101"]
    crowd = places.limit(1).crossJoin(spark.range(70)).drop("id")
    warehouse.load(places.union(crowd), "silver", "erp_loc_a101")
    views.create_gold_views(warehouse, 20, ("dim_customers", "dim_products"))
    expected = gold.dim_customers(
        {t: warehouse.read("silver", t) for t in ("crm_cust_info", "erp_cust_az12", "erp_loc_a101")}
    )
    got = warehouse.read("gold", "dim_customers")
    assert frame_bag(got) == frame_bag(expected) and got.count() == 219
    # Silver grows: the old bounds still give dense keys in order
    warehouse.load(warehouse.read("silver", "crm_cust_info").withColumn("cst_id", F.concat("cst_id", F.lit("9"))).union(
        warehouse.read("silver", "crm_cust_info")), "silver", "crm_cust_info")
    keys = [r["customer_key"] for r in got.sparkSession.table(warehouse.name("gold", "dim_customers")).orderBy("customer_id", "customer_key").collect()]
    assert keys == list(range(1, len(keys) + 1))
    warehouse.drop_layers()


def test_managed_tables(spark, landing):
    spark.sql("DROP TABLE IF EXISTS bronze.erp_loc_a101")
    warehouse = Warehouse(spark)
    rows = warehouse.load(EXTRACTS["erp_loc_a101"](spark, "/root/testdata/sf0.001"), "bronze",
                          "erp_loc_a101")
    assert rows == 142
    assert os.path.isdir(
        spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:") + "/bronze.db/erp_loc_a101"
    )


def test_unknown_layer_is_refused(spark):
    with pytest.raises(ValueError, match="unknown layer"):
        Warehouse(spark).load(spark.range(1), "platinum", "x")


def test_empty_extracts(spark, tmp_path, loaded, landing, root):
    for source in SOURCES:
        (tmp_path / source.file).write_text(",".join(source.columns) + "\n")
    report = pipeline.run_pipeline(spark, str(tmp_path), str(tmp_path / "tables"))
    assert {n for layer in report.rows.values() for n in layer.values()} == {0}
    rows = pipeline.validate(Warehouse(spark)).collect()
    assert {r["violations"] for r in rows} == {0}
    assert pipeline.run_pipeline(spark, landing, root).rows["gold"] == GOLD


def test_failed_load_keeps_the_old_rows(spark, tmp_path):
    for root in (str(tmp_path / "tables"), None):
        warehouse = Warehouse(spark, root, prefix="keep_")
        warehouse.create_layers()
        warehouse.load(spark.range(5).selectExpr("cast(id as string) as id"), "bronze", "kept")
        failing = spark.range(3).selectExpr("if(id = 2, raise_error('broken row'), 'x') as id")
        with pytest.raises(Exception, match="broken row"):
            warehouse.load(failing, "bronze", "kept")
        assert warehouse.read("bronze", "kept").count() == 5
        tables = {t.name for t in spark.catalog.listTables("keep_bronze")}
        assert tables == {"kept"}
        # another schema, then the same one again: the table is replaced and only one folder remains
        assert warehouse.load(spark.range(2).toDF("n"), "bronze", "kept") == 2
        assert warehouse.load(spark.range(4).toDF("n"), "bronze", "kept") == 4
        assert warehouse.read("bronze", "kept").columns == ["n"]
        assert warehouse.read("bronze", "kept").count() == 4
        versions = warehouse.journal("bronze", "kept")
        assert len(versions.complete()) == 3 and versions.unfinished() == []
        if root:
            assert sorted(os.listdir(f"{root}/bronze/kept")) == sorted([*versions.complete(), "_staged", "_committed"])
        warehouse.drop_layers()
    assert not {"keep_bronze", "keep_gold"} & {row[0] for row in spark.sql("SHOW SCHEMAS").collect()}


def test_queries_leave_the_tables_of_others_alone(spark, sf_dir, loaded):
    import __spark_entry__ as entry_points

    before = frame_bag(loaded[0].read("silver", "erp_px_cat_g1v2"))
    for name in ("bronze_counts", "live_dim_products", "load_report"):
        entry_points.queries()[name](spark, sf_dir).count()
    assert frame_bag(loaded[0].read("silver", "erp_px_cat_g1v2")) == before


class Killed(Exception):
    """The driver is gone."""


@pytest.mark.parametrize("step", ["createTable", "refreshTable"])
@pytest.mark.parametrize("with_root", [True, False])
def test_a_load_killed_between_two_catalog_steps_is_completed(spark, tmp_path, monkeypatch, step, with_root):
    root = str(tmp_path / "tables") if with_root else None
    warehouse = Warehouse(spark, root, prefix="kill_")
    warehouse.create_layers()
    warehouse.load(spark.range(5).toDF("a"), "silver", "t")

    def killed(*args, **kwargs):
        raise Killed

    with monkeypatch.context() as patch:
        patch.setattr(type(spark.catalog), step, killed)
        with pytest.raises(Killed):
            warehouse.load(spark.range(7).toDF("b"), "silver", "t")
    again = Warehouse(spark, root, prefix="kill_")
    again.create_layers()
    assert again.read("silver", "t").columns == ["b"] and again.read("silver", "t").count() == 7
    assert again.loaded_rows("silver", "t") == 7
    assert again.recover() == {}
    warehouse.drop_layers()


def test_a_load_killed_while_it_writes_is_rolled_back(spark, tmp_path, monkeypatch):
    warehouse = Warehouse(spark, str(tmp_path / "tables"), prefix="half_")
    warehouse.create_layers()
    warehouse.load(spark.range(5).toDF("a"), "silver", "t")

    def killed(*args, **kwargs):
        raise Killed

    with monkeypatch.context() as patch:
        patch.setattr("oreline.sources.journal.Journal.commit", killed)
        with pytest.raises(Killed):
            warehouse.load(spark.range(7).toDF("b"), "silver", "t")
    assert len(os.listdir(tmp_path / "tables/silver/t")) == 4  # two versions
    assert Warehouse(spark, str(tmp_path / "tables"), prefix="half_").recover() == {"half_silver.t": "rolled back"}
    assert len(os.listdir(tmp_path / "tables/silver/t")) == 3
    assert warehouse.read("silver", "t").count() == 5 and warehouse.read("silver", "t").columns == ["a"]
    # a catalog that has lost the table gets it back from the files
    spark.sql("DROP TABLE half_silver.t")
    assert warehouse.recover() == {"half_silver.t": "attached"}
    assert warehouse.read("silver", "t").count() == 5
    warehouse.drop_layers()


def test_frames_opened_before_a_reload_still_read_their_rows(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "tables"), prefix="read_", keep=2)
    warehouse.create_layers()
    frames = []
    for n in range(1, 6):
        warehouse.load(spark.range(n).toDF("a"), "gold", "t")
        frames.append(warehouse.read("gold", "t"))
        assert [f.count() for f in frames[-3:]] == list(range(max(1, n - 2), n + 1))
    assert len(warehouse.journal("gold", "t").complete()) == 3
    warehouse.drop_layers()


def test_rules_survive_tasks_that_ran_twice(loaded, monkeypatch):
    """Observed sums that do not agree with the exact row counts are counted again."""
    silver, fact = loaded[0].silver_tables(), loaded[0].read("gold", "fact_sales")
    expected = sorted(map(tuple, quality.quality_report(silver, fact).collect()))

    class Twice(quality.Observation):
        @property
        def get(self):
            return {name: 2 * n for name, n in super().get.items()}

    monkeypatch.setattr(quality, "Observation", Twice)
    assert sorted(map(tuple, quality.quality_report(silver, fact).collect())) == expected


def test_only_keys_are_shuffled_for_the_rules(loaded):
    silver = loaded[0].silver_tables()
    sums = quality._key_sums
    frames = []

    def spy(*args):
        frames.extend(args)
        return sums(*args)

    quality._key_sums = spy
    try:
        quality.quality_report(silver, loaded[0].read("gold", "fact_sales"))
    finally:
        quality._key_sums = sums
    assert "CollectMetrics" in frames[0]._jdf.queryExecution().toString()
    lookups = gold.broadcast_if_small(silver["crm_cust_info"], silver["erp_px_cat_g1v2"], limit=40_000)
    hinted = ["ResolvedHint" in df._jdf.queryExecution().analyzed().toString() for df in lookups]
    assert hinted == [False, True]


def test_live_fact_sorts_no_order_lines_and_casts_amounts_once(spark, sf_dir, tmp_path):
    import __spark_entry__ as entry

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fact = entry.queries()["live_fact_sales"](spark, sf_dir)
        rows = fact.collect()
        plan = fact._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    top = [line for line in plan.splitlines() if "Join" in line][:2]
    assert len(top) == 2 and all("ShuffledHashJoin" in line for line in top)
    whole = entry.queries()["gold_fact_sales"](spark, sf_dir)
    assert frame_bag(whole) == frame_bag(spark.createDataFrame(rows, fact.schema))
    for field in GOLD_CONTRACT["fact_sales"]:
        assert conform.fitted(field.name, field.dataType).count("TRY_CAST") == 1
