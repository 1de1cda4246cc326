"""The whole load, layer by layer."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date
from typing import Literal

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from oreline.plans import gold
from oreline.plans.quality import load_counts, quality_report, require_no_difference
from oreline.plans.silver import silver_builders
from oreline.plans.views import create_gold_views, drop_bounds, refresh_bounds
from oreline.schemas import SOURCE_TABLES, SOURCES, Source
from oreline.session import tune
from oreline.sources.csv import LINE_BREAK, read_csv
from oreline.sources.tables import Warehouse, stamped

# Tables of one layer do not depend on each other, so a small one need not wait for a large one.
PARALLEL_LOADS = 3


@dataclass
class LoadReport:
    """Rows written per table, by layer; Gold is empty when it consists of views."""

    rows: dict[str, dict[str, int]] = field(default_factory=dict)


def _together(tables: Iterable[str], load: Callable[[str], int]) -> dict[str, int]:
    names = list(tables)
    with ThreadPoolExecutor(PARALLEL_LOADS) as pool:
        return dict(zip(names, pool.map(load, names), strict=True))


def read_extract(
    spark: SparkSession, landing: str, source: Source, multi_line: bool | None = None
) -> DataFrame:
    return read_csv(spark, os.path.join(landing, source.file), source.columns, multi_line)


def load_bronze(warehouse: Warehouse, landing: str) -> dict[str, int]:
    """Land the six extracts unchanged.

    Each is read once, line by line. Only where that meets a quoted line break, the load is done again, with
    the files that have one read whole.
    """
    sources = {source.table: source for source in SOURCES}

    def load(table: str) -> int:
        def land(multi_line: bool | None) -> int:
            extract = read_extract(warehouse.spark, landing, sources[table], multi_line)
            return warehouse.load(extract, "bronze", table)

        try:
            return land(False)
        except PySparkException as problem:
            if LINE_BREAK not in str(problem):
                raise
            return land(None)

    return _together(sources, load)


def load_silver(warehouse: Warehouse, as_of: date | None = None) -> dict[str, int]:
    builders = silver_builders(as_of)

    def load(table: str) -> int:
        cleansed = builders[table](warehouse.read("bronze", table))
        return warehouse.load(stamped(cleansed), "silver", table)

    rows = _together(SOURCE_TABLES, load)
    refresh_bounds(warehouse)
    return rows


def load_gold(warehouse: Warehouse) -> dict[str, int]:
    """Load the dimensions, then the fact table from the dimensions as stored."""
    silver = warehouse.silver_tables()
    builders = {"dim_customers": gold.dim_customers, "dim_products": gold.dim_products}
    for table in [*builders, "fact_sales"]:
        warehouse.make_room("gold", table, for_view=False)
    rows = _together(
        builders, lambda table: warehouse.load(builders[table](silver), "gold", table)
    )
    fact = gold.fact_sales(
        silver["crm_sales_details"],
        warehouse.read("gold", "dim_products"),
        warehouse.read("gold", "dim_customers"),
    )
    drop_bounds(warehouse)
    return {**rows, "fact_sales": warehouse.load(fact, "gold", "fact_sales")}


def run_pipeline(
    spark: SparkSession,
    landing: str,
    root: str | None = None,
    as_of: date | None = None,
    materialize: Literal["table", "view"] = "table",
) -> LoadReport:
    """Land, cleanse, build the star schema. Every load overwrites, so it can be run again."""
    tune(spark)
    warehouse = Warehouse(spark, root)
    warehouse.create_layers()
    report = LoadReport()
    report.rows["bronze"] = load_bronze(warehouse, landing)
    report.rows["silver"] = load_silver(warehouse, as_of)
    if materialize == "view":
        create_gold_views(warehouse)
    else:
        report.rows["gold"] = load_gold(warehouse)
    return report


def reconcile(warehouse: Warehouse, landing: str | None = None) -> DataFrame:
    """Rows of the extracts against rows of the Bronze tables.

    The extracts' rows are those that the last load counted while it read them; with ``landing`` the
    files are read and counted again.
    """
    if landing is None:
        extracts = {s.table: warehouse.loaded_rows("bronze", s.table) or 0 for s in SOURCES}
    else:
        extracts = {s.table: read_extract(warehouse.spark, landing, s) for s in SOURCES}
    return load_counts(extracts, warehouse.bronze_tables())


def validate(warehouse: Warehouse, strict: bool = True) -> DataFrame:
    """The quality report, computed when called; ``strict`` raises unless the fact table has one row
    per order line."""
    report = quality_report(warehouse.silver_tables(), warehouse.read("gold", "fact_sales"))
    rows = report.collect()  # a row for each rule
    if strict:
        require_no_difference(rows)
    return warehouse.spark.createDataFrame(rows, report.schema)
