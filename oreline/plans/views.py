"""The star schema as live views: always current with Silver, computed when read.

A view cannot store anything, so its surrogate keys are numbered by buckets: rows in smaller buckets plus the
position within the bucket. Buckets are bounded by keys of the full sort order, taken where a range shuffle would cut the rows, so they
are even however the keys look; any bounds give the same keys. The bounds are a small table beside the view, in groups: a row is
compared with the first bound of each group, then with those of its own group, about twice the root of their number.
Every load of Silver takes them anew (``refresh_bounds``), so buckets stay even while Silver grows.
Equal rows are one row with a count until they have their keys, so repeated keys do not fill a bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oreline.operators.conform import fitted
from oreline.schemas import GOLD_CONTRACT
from oreline.sources.tables import Warehouse

BUCKET_ROWS = 1_000_000
MOST_BUCKETS = 65_536  # also the rows of the one window that is not partitioned
GOLD = ("dim_customers", "dim_products", "fact_sales")
_ROWS_PROPERTY = "oreline.bucket_rows"
_GROUP_STEP = 1_000_000  # more than the bounds of a group


def _key(order: list[str]) -> str:
    """A struct that sorts like ``order`` with missing values last."""
    return f"struct({', '.join(f'{c} IS NULL, {c}' for c in order)})"


def bounds(df: DataFrame, order: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Keys that cut ``df`` into buckets of about ``bucket_rows`` rows, in groups of ascending ones: (``grp``,
    ``first``, ``keys``). ``MOST_BUCKETS`` keys at most."""
    buckets = max(1, min(MOST_BUCKETS, -(-df.count() // bucket_rows)))
    keys = df.select(*order)
    cut = keys.repartitionByRange(buckets, *[F.col(c).asc_nulls_last() for c in order])
    first = cut.groupBy(F.spark_partition_id()).agg(F.min(F.expr(_key(order))).alias("key"))
    place = F.row_number().over(Window.orderBy("key")) - 2  # the smallest bounds nothing
    width = max(1, round(buckets**0.5))
    grouped = first.withColumn("place", place).filter("place >= 0")
    grouped = grouped.groupBy(F.expr(f"place div {width}").alias("grp")).agg(
        F.min("key").alias("first"), F.array_sort(F.collect_list("key")).alias("keys")
    )
    return grouped


def bounds_table(table: str) -> str:
    return f"{table}__bounds"


def bucket_sql(rows: str, cuts: str, order: list[str]) -> str:
    """Common tables that end in ``bucketed``: the rows of the common table ``rows`` with their ``bucket``, a number that ascends with the
    bounds in the table ``cuts``."""
    # Subqueries may not stand inside calls with lambdas, so each is a column first. These columns and the group are used
    # once and thus inlined: the bounds are read when the query begins, and no row carries them.
    key = _key(order)
    return f"""
bounded AS (
  SELECT *, (SELECT transform(array_sort(collect_list(struct(grp, first))), x -> x.first) FROM {cuts}) AS firsts,
         (SELECT transform(array_sort(collect_list(struct(grp, keys))), x -> x.keys) FROM {cuts}) AS groups
  FROM {rows}),
bucketed AS (
  SELECT * EXCEPT (firsts, groups), transform(array(size(filter(firsts, c -> c <= {key}))), g ->
    CASE WHEN g = 0 THEN 0L ELSE g * {_GROUP_STEP}L + size(filter(get(groups, g - 1), c -> c <= {key})) END)[0] AS bucket
  FROM bounded)"""


def _typed(table: str, skip: str) -> str:
    fields = [f for f in GOLD_CONTRACT[table].fields if f.name != skip]
    return ", ".join(f"{fitted(f.name, f.dataType)} AS {f.name}" for f in fields)


def _numbered(parts: str, table: str, key: str, order: list[str], cuts: str) -> str:
    """SELECT of ``table`` with dense keys over ``joined``, the last of the common tables ``parts``."""
    sort = ", ".join(f"{c} ASC NULLS LAST" for c in order)
    return f"""
WITH {parts},{bucket_sql("joined", cuts, order)},
sizes AS (SELECT bucket, sum(copies) AS n FROM bucketed GROUP BY bucket),
offsets AS (
  SELECT bucket, coalesce(sum(n) OVER (
    ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes),
numbered AS (
  SELECT r.*, o.before + coalesce(sum(copies) OVER (PARTITION BY r.bucket ORDER BY {sort}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM bucketed r JOIN offsets o ON r.bucket = o.bucket),
repeated AS (SELECT *, explode(sequence(1L, copies)) AS copy FROM numbered)
SELECT CAST(first + copy AS BIGINT) AS {key}, {_typed(table, key)} FROM repeated"""


CUSTOMER_ORDER = [f.name for f in GOLD_CONTRACT["dim_customers"].fields if f.name != "customer_key"]
PRODUCT_ORDER = [
    "start_date",
    "product_number",
    "product_id",
    "product_name",
    "category_id",
    "cost",
    "product_line",
    "category",
    "subcategory",
    "maintenance",
]


def _customer_parts(silver: str) -> str:
    return f"""
people AS (
  SELECT cid, bdate, gen, count(*) AS n FROM {silver}.erp_cust_az12 GROUP BY cid, bdate, gen),
places AS (SELECT cid, cntry, count(*) AS n FROM {silver}.erp_loc_a101 GROUP BY cid, cntry),
joined AS (
  SELECT c.cst_id AS customer_id, c.cst_key AS customer_number, c.cst_firstname AS first_name,
         c.cst_lastname AS last_name, l.cntry AS country, c.cst_marital_status AS marital_status,
         CASE WHEN c.cst_gndr <> 'n/a' THEN c.cst_gndr ELSE coalesce(d.gen, 'n/a') END AS gender,
         d.bdate AS birthdate, c.cst_create_date AS create_date,
         coalesce(d.n, 1) * coalesce(l.n, 1) AS copies
  FROM {silver}.crm_cust_info c
  LEFT JOIN people d ON c.cst_key = d.cid
  LEFT JOIN places l ON c.cst_key = l.cid)"""


def _product_parts(silver: str) -> str:
    return f"""
current AS (
  SELECT prd_id, prd_key, prd_nm, cat_id, prd_cost, prd_line, prd_start_dt, count(*) AS n
  FROM {silver}.crm_prd_info WHERE prd_end_dt IS NULL GROUP BY ALL),
categories AS (
  SELECT id, cat, subcat, maintenance, count(*) AS n FROM {silver}.erp_px_cat_g1v2
  GROUP BY id, cat, subcat, maintenance),
joined AS (
  SELECT p.prd_id AS product_id, p.prd_key AS product_number, p.prd_nm AS product_name,
         p.cat_id AS category_id, c.cat AS category, c.subcat AS subcategory, c.maintenance,
         p.prd_cost AS cost, p.prd_line AS product_line, p.prd_start_dt AS start_date,
         p.n * coalesce(c.n, 1) AS copies
  FROM current p LEFT JOIN categories c ON p.cat_id = c.id)"""


def _sales_sql(silver: str, gold: str) -> str:
    rows = f"""
  SELECT s.sls_ord_num AS order_number, p.product_key, c.customer_key,
         s.sls_order_dt AS order_date, s.sls_ship_dt AS ship_date, s.sls_due_dt AS due_date,
         s.sls_sales AS sales_amount, s.sls_quantity AS quantity, s.sls_price AS price
  FROM {silver}.crm_sales_details s
  LEFT JOIN {gold}.dim_products p ON s.sls_prd_key = p.product_number
  LEFT JOIN {gold}.dim_customers c ON s.sls_cust_id = c.customer_id"""
    return f"SELECT {_typed('fact_sales', '')} FROM ({rows})"


DIMENSIONS = {
    "dim_customers": (_customer_parts, "customer_key", CUSTOMER_ORDER),
    "dim_products": (_product_parts, "product_key", PRODUCT_ORDER),
}


def _load_bounds(warehouse: Warehouse, table: str, bucket_rows: int) -> None:
    parts, _, order = DIMENSIONS[table]
    rows = warehouse.spark.sql(f"WITH {parts(warehouse.schema('silver'))} SELECT * FROM joined")
    warehouse.load(bounds(rows, order, bucket_rows), "gold", bounds_table(table))


def create_gold_views(
    warehouse: Warehouse,
    bucket_rows: int = BUCKET_ROWS,
    only: tuple[str, ...] = GOLD,
) -> None:
    """Define the Gold objects as views over Silver, in place of loaded tables."""
    silver, gold = warehouse.schema("silver"), warehouse.schema("gold")
    for table in only:
        if table in DIMENSIONS:
            _load_bounds(warehouse, table, bucket_rows)
            parts, key, order = DIMENSIONS[table]
            cuts = warehouse.name("gold", bounds_table(table))
            sql = _numbered(parts(silver), table, key, order, cuts)
        else:
            sql = _sales_sql(silver, gold)
        warehouse.make_room("gold", table, for_view=True)
        warehouse.spark.sql(
            f"CREATE OR REPLACE VIEW {warehouse.name('gold', table)}"
            f" TBLPROPERTIES ('{_ROWS_PROPERTY}' = '{bucket_rows}') AS {sql}"
        )


def refresh_bounds(warehouse: Warehouse) -> list[str]:
    """Take the bounds of the dimensions that are views anew, as Silver is now; returns their names."""
    catalog, done = warehouse.spark.catalog, []
    for table in DIMENSIONS:
        name = warehouse.name("gold", table)
        if catalog.tableExists(name) and catalog.getTable(name).tableType == "VIEW":
            rows = warehouse.spark.sql(f"SHOW TBLPROPERTIES {name} ('{_ROWS_PROPERTY}')").first()["value"]
            _load_bounds(warehouse, table, int(rows))
            done.append(table)
    return done


def drop_bounds(warehouse: Warehouse) -> None:
    """Remove the bounds of views that tables have replaced."""
    for table in DIMENSIONS:
        warehouse.drop("gold", bounds_table(table))
