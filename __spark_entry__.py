
from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.duckdb_sql import ORACLES  # noqa: E402
from oreline.functions import codes, parsing, text  # noqa: E402
from oreline.operators.keys import dense_key  # noqa: E402
from oreline.operators.latest import latest_per_key  # noqa: E402
from oreline.operators.lookup import orphan_rows  # noqa: E402
from oreline.plans import gold, pipeline, profiling, quality, reports, silver, views  # noqa: E402
from oreline.schemas import GOLD_CONTRACT, LOAD_STAMP, SOURCES  # noqa: E402
from oreline.session import at_end, run_folder, tune  # noqa: E402
from oreline.sources.csv import read_csv, write_csv  # noqa: E402
from oreline.sources.samples import EXTRACTS, HARD_EXTRACTS  # noqa: E402
from oreline.sources.tables import Warehouse, stamped  # noqa: E402

# The operators on training data are optional: everything else works without their folder
# and without the packages that only they need.
try:
    from oreline.llm import queries as llm_queries
except ImportError:
    llm_queries = None
try:
    import corpus_pipeline
except ImportError:
    corpus_pipeline = None

SMOKE_DIR = "/root/testdata/sf0.001"

Query = Callable[[SparkSession, str], DataFrame]


class _OnDemand(dict):
    """Tables by name, planned when first read."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]) -> None:
        super().__init__()
        self.builders = builders

    def __missing__(self, table: str) -> DataFrame:
        self[table] = self.builders[table]()
        return self[table]


class Layers:
    """The layers over one set of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, hard: tuple[str, ...] = ()) -> None:
        tune(spark)
        extracts = {**EXTRACTS, **{table: HARD_EXTRACTS[table] for table in hard}}
        self.bronze = _OnDemand({t: partial(b, spark, sf_dir) for t, b in extracts.items()})
        self.silver = _OnDemand(
            {t: partial(self._cleanse, t, b) for t, b in silver.silver_builders().items()}
        )

    def _cleanse(self, table: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return build(self.bronze[table])

    def customers(self) -> DataFrame:
        return gold.dim_customers(self.silver)

    def products(self) -> DataFrame:
        return gold.dim_products(self.silver)

    def sales(self) -> DataFrame:
        return self.silver["crm_sales_details"]

    def dimensions(self) -> tuple[DataFrame, DataFrame]:
        """Products and customers, whose keys are assigned at the same time."""
        with ThreadPoolExecutor(2) as pool:
            products, customers = pool.submit(self.products), pool.submit(self.customers)
            return products.result(), customers.result()

    def fact(self) -> DataFrame:
        return gold.fact_sales(self.sales(), *self.dimensions())


def _sales_by_country(layers: Layers) -> DataFrame:
    products, customers = layers.dimensions()
    fact = gold.fact_sales(layers.sales(), products, customers)
    return reports.sales_by_country(fact, customers)


def _bronze_table(table: str, profile: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: profile(EXTRACTS[table](spark, sf_dir))


def _layered(build: Callable[[Layers], DataFrame], hard: tuple[str, ...] = ()) -> Query:
    """A query over the layers; the extracts of the ``hard`` tables are those with awkward rows."""
    return lambda spark, sf_dir: build(Layers(spark, sf_dir, hard))


def _own_warehouse(spark: SparkSession) -> Warehouse:
    """A warehouse in a new folder and namespace; both go when the driver's Python ends.

    Queries load into it, so they never touch the tables of others.
    """
    folder = run_folder(spark, "query")
    warehouse = Warehouse(spark, f"{folder}/tables", prefix=f"q{uuid.uuid4().hex}_")
    warehouse.create_layers()
    at_end(spark, warehouse.drop_layers)
    return warehouse


def _landed(table: str) -> Query:
    """The extract written as CSV and read back, untyped."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{run_folder(spark, 'query')}/{table}.csv"
        extract = EXTRACTS[table](spark, sf_dir)
        write_csv(extract, path)
        return read_csv(spark, path, extract.columns, multi_line=False)

    return query


def _line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with line breaks, quotes and commas in a field, written as CSV and read back by ranges."""
    path = f"{run_folder(spark, 'query')}/line_breaks.csv"
    extract = EXTRACTS["crm_cust_info"](spark, sf_dir).withColumn(
        "cst_lastname",
        F.expr(
            "case when cst_key like '%3' then concat(cst_lastname, char(10), '\"', cst_firstname, '\"')"
            " when cst_key like '%7' then concat(char(10), char(10), cst_lastname, ',') else cst_lastname end"
        ),
    )
    write_csv(extract, path)
    return read_csv(spark, path, extract.columns)


def _bronze_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the landed CSV files against rows of the Bronze tables loaded from them."""
    warehouse, folder = _own_warehouse(spark), run_folder(spark, "query")
    for source in SOURCES:
        write_csv(EXTRACTS[source.table](spark, sf_dir), f"{folder}/{source.file}")
    pipeline.load_bronze(warehouse, folder)
    return pipeline.reconcile(warehouse)


def _live(table: str, inputs: tuple[str, ...]) -> Query:
    """A Gold view over Silver tables loaded from the extracts."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        layers = Layers(spark, sf_dir)
        warehouse = _own_warehouse(spark)
        for name in inputs:
            warehouse.load(stamped(layers.silver[name]), "silver", name)
        views.create_gold_views(warehouse, only=(table,) if table != "fact_sales" else views.GOLD)
        return warehouse.read("gold", table)

    return query


def _load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each load of a Silver table reports, against those that the table then has."""
    layers, warehouse = Layers(spark, sf_dir), _own_warehouse(spark)
    tables = [s.table for s in SOURCES]
    rows = [(t, warehouse.load(stamped(layers.silver[t]), "silver", t)) for t in tables]
    reported = spark.createDataFrame(rows, "table string, reported_rows long")
    counted = [
        warehouse.read("silver", t).agg(F.count(F.lit(1)).alias("stored_rows")).withColumn("table", F.lit(t))
        for t in tables
    ]
    return reported.join(reduce(DataFrame.unionByName, counted), "table")


def _reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a frame opened before a reload still reads, rows after the reload, and rows of a third load that was
    complete when it was broken off, put in place by the next warehouse."""
    layers, warehouse = Layers(spark, sf_dir), _own_warehouse(spark)
    halves = {"erp_loc_a101": F.col("cntry") == "Germany", "erp_cust_az12": F.col("gen") == "Male"}
    rows = []
    for table, half in halves.items():
        warehouse.load(layers.silver[table], "silver", table)
        opened = warehouse.read("silver", table)
        warehouse.load(opened.filter(half), "silver", table)
        reloaded = warehouse.read("silver", table).count()
        journal = warehouse.journal("silver", table)
        version = journal.begin()
        opened.write.format(warehouse.file_format).save(journal.location(version))
        journal.commit(version, opened.count())
        Warehouse(spark, warehouse.root, prefix=warehouse.prefix).recover()
        rows.append((table, opened.count(), reloaded, warehouse.read("silver", table).count()))
    return spark.createDataFrame(rows, "table string, open_rows long, reloaded_rows long, recovered_rows long")


def _silver_load_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each loaded Silver table, its rows, rows without a load time, and different load times."""
    layers, warehouse = Layers(spark, sf_dir), _own_warehouse(spark)
    parts = []
    for source in SOURCES:
        warehouse.load(stamped(layers.silver[source.table]), "silver", source.table)
        stamp = F.col(LOAD_STAMP)
        parts.append(
            warehouse.read("silver", source.table).agg(
                F.count(F.lit(1)).alias("rows"),
                F.count_if(stamp.isNull()).alias("without_time"),
                F.count_distinct(stamp).alias("load_times"),
            ).withColumn("table", F.lit(source.table))
        )
    return reduce(DataFrame.unionByName, parts)


def _preview(table: str, order: tuple[str, ...], build: Callable[[Layers], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        warehouse = _own_warehouse(spark)
        warehouse.load(build(Layers(spark, sf_dir)), "gold", table)
        return warehouse.preview("gold", table, order)

    return query


def _parsed_sales(bronze: DataFrame) -> DataFrame:
    """Order lines with typed dates and numbers, before any repair."""
    dates = ("sls_order_dt", "sls_ship_dt", "sls_due_dt")
    numbers = ("sls_sales", "sls_quantity", "sls_price")
    return bronze.select(
        "sls_ord_num",
        *[parsing.parse_compact_date(F.col(c)).alias(c) for c in dates],
        *[parsing.parse_number(F.col(c)).alias(c) for c in numbers],
    )


def _latest_customers(bronze: DataFrame) -> DataFrame:
    ties = [c for c in bronze.columns if c != "cst_id"]
    recency = parsing.parse_moment(F.col("cst_create_date"))
    identified = bronze.filter(~text.is_blank(F.col("cst_id")))
    return latest_per_key(identified, "cst_id", recency, ties).select(
        "cst_id", "cst_key", "cst_create_date"
    )


def _split_keys(bronze: DataFrame) -> DataFrame:
    category, number = silver.split_product_key(F.col("prd_key"))
    return bronze.select("prd_id", category.alias("cat_id"), number.alias("prd_key"))


def _line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense keys over all order lines, by customer and order."""
    lines = EXTRACTS["crm_sales_details"](spark, sf_dir).select(
        "sls_cust_id", "sls_ord_num", "sls_prd_key", "sls_quantity", "sls_sales"
    )
    return dense_key(lines, "line_key", ["sls_cust_id", "sls_ord_num"])


def _known_gender(layers: Layers) -> DataFrame:
    """Gender of each customer with a demographic record, CRM before ERP."""
    customers, people = layers.silver["crm_cust_info"], layers.silver["erp_cust_az12"]
    return customers.join(people, F.col("cst_key") == F.col("cid"), "left").select(
        "cst_id", codes.prefer_known(F.col("cst_gndr"), F.col("gen")).alias("gender")
    )


def entry(spark: SparkSession) -> DataFrame:
    """Total sales by country on the smallest test tables."""
    return _sales_by_country(Layers(spark, SMOKE_DIR))


def queries() -> dict[str, Query]:
    profiles = {
        "profile_crm_cust": "crm_cust_info",
        "profile_crm_prd": "crm_prd_info",
        "profile_crm_sales": "crm_sales_details",
        "profile_erp_cust": "erp_cust_az12",
        "profile_erp_loc": "erp_loc_a101",
        "profile_erp_cat": "erp_px_cat_g1v2",
    }
    cleansed = {
        "silver_crm_cust": "crm_cust_info",
        "silver_crm_prd": "crm_prd_info",
        "silver_crm_sales": "crm_sales_details",
        "silver_erp_cust": "erp_cust_az12",
        "silver_erp_loc": "erp_loc_a101",
        "silver_erp_cat": "erp_px_cat_g1v2",
    }
    builders = silver.silver_builders()
    short = {table: name.removeprefix("silver_") for name, table in cleansed.items()}
    return {
        "bronze_counts": _bronze_counts,
        **{f"bronze_{short[t]}": _landed(t) for t in cleansed.values()},
        "bronze_line_breaks": _line_breaks,
        **{q: _bronze_table(t, profiling.PROFILES[t]) for q, t in profiles.items()},
        **{q: _bronze_table(t, builders[t]) for q, t in cleansed.items()},
        "parsed_sales": _bronze_table("crm_sales_details", _parsed_sales),
        "split_product_keys": _bronze_table("crm_prd_info", _split_keys),
        "latest_customers": _bronze_table("crm_cust_info", _latest_customers),
        "known_gender": _layered(_known_gender),
        "dense_line_keys": _line_keys,
        "gold_dim_customers": _layered(Layers.customers),
        "gold_dim_products": _layered(Layers.products),
        "gold_fact_sales": _layered(Layers.fact),
        "dq_unique_keys": _layered(
            lambda x: quality.unique_keys(x.silver["crm_cust_info"], x.silver["crm_prd_info"])
        ),
        "dq_coded_values": _layered(lambda x: quality.coded_values(x.silver)),
        "dq_domains": _layered(lambda x: quality.unapproved_values(x.silver)),
        "dq_date_order": _layered(lambda x: quality.date_order(x.sales())),
        "dq_sales_amount": _layered(lambda x: quality.sales_amount(x.sales())),
        "dq_orphan_customers": _layered(
            lambda x: quality.orphan_customers(x.sales(), x.silver["crm_cust_info"])
        ),
        "dq_orphan_products": _layered(
            lambda x: quality.orphan_products(x.sales(), x.silver["crm_prd_info"])
        ),
        "orphan_customer_rows": _layered(
            lambda x: orphan_rows(x.sales(), "sls_cust_id", x.silver["crm_cust_info"], "cst_id")
        ),
        "orphan_product_rows": _layered(
            lambda x: orphan_rows(x.sales(), "sls_prd_key", x.silver["crm_prd_info"], "prd_key")
        ),
        "dq_row_reconcile": _layered(lambda x: quality.row_reconcile(x.sales(), x.fact())),
        "dq_missing_keys": _layered(lambda x: quality.missing_keys(x.fact())),
        "dq_gold_amount": _layered(lambda x: quality.gold_amount(x.fact())),
        "hard_silver_sales": _layered(Layers.sales, ("crm_sales_details",)),
        "hard_silver_versions": _layered(lambda x: x.silver["crm_prd_info"], ("crm_prd_info",)),
        "hard_dim_customers": _layered(Layers.customers, ("erp_cust_az12", "erp_loc_a101")),
        "hard_gold_amount": _layered(lambda x: quality.gold_amount(x.fact()), ("crm_sales_details",)),
        "reloaded_tables": _reloaded,
        "dq_report": _layered(lambda x: quality.quality_report(x.silver, x.fact())),
        "sales_by_country": _layered(_sales_by_country),
        "profile_report": _layered(lambda x: profiling.profile_all(x.bronze)),
        "live_dim_customers": _live(
            "dim_customers", ("crm_cust_info", "erp_cust_az12", "erp_loc_a101")
        ),
        "live_dim_products": _live("dim_products", ("crm_prd_info", "erp_px_cat_g1v2")),
        "live_fact_sales": _live("fact_sales", tuple(s.table for s in SOURCES)),
        "load_report": _load_report,
        "silver_load_times": _silver_load_times,
        "preview_dim_customers": _preview(
            "dim_customers", ("customer_key",), Layers.customers
        ),
        "preview_fact_sales": _preview(
            "fact_sales", tuple(GOLD_CONTRACT["fact_sales"].names), Layers.fact
        ),
        **(llm_queries.QUERIES if llm_queries else {}),
        **({"pipeline": corpus_pipeline.run} if corpus_pipeline else {}),
    }


def oracle_sql() -> dict[str, str]:
    statements = dict(ORACLES)
    if llm_queries:
        statements.update(llm_queries.ORACLES)
    if corpus_pipeline and corpus_pipeline.ORACLE_SQL:
        statements["pipeline"] = corpus_pipeline.ORACLE_SQL
    return statements
