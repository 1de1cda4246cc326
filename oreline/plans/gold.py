"""Silver to the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreline.functions.codes import prefer_known
from oreline.operators.conform import conform
from oreline.operators.copies import count_copies
from oreline.operators.keys import dense_key
from oreline.operators.lookup import BROADCAST_BYTES, broadcast_if_small
from oreline.schemas import GOLD_CONTRACT


def _multiplicity(*counts: str):
    """Rows a joined row stands for: unmatched sides count once."""
    total = F.lit(1).cast("long")
    for count in counts:
        total = total * F.coalesce(F.col(count), F.lit(1))
    return total.alias("_copies")


def customer_rows(
    customers: DataFrame, demographics: DataFrame, locations: DataFrame
) -> DataFrame:
    """Customers with ERP attributes; ``_copies`` says how many joined rows a row stands for.

    A repeated ERP key multiplies customers, as the joins say. Its copies are counted before the
    shuffle and multiplied here, so they never pile up in one join task.
    """
    people = count_copies(demographics.select(F.col("cid").alias("_cid"), "bdate", "gen"), "_n_demo")
    places = count_copies(locations.select(F.col("cid").alias("_cid_loc"), "cntry"), "_n_loc")
    # Silver column names and the Gold names they get.
    return (
        customers.join(people, F.col("cst_key") == F.col("_cid"), "left")
        .join(places, F.col("cst_key") == F.col("_cid_loc"), "left")
        .select(
            F.col("cst_id").alias("customer_id"),
            F.col("cst_key").alias("customer_number"),
            F.col("cst_firstname").alias("first_name"),
            F.col("cst_lastname").alias("last_name"),
            F.col("cntry").alias("country"),
            F.col("cst_marital_status").alias("marital_status"),
            prefer_known(F.col("cst_gndr"), F.col("gen")).alias("gender"),
            F.col("bdate").alias("birthdate"),
            F.col("cst_create_date").alias("create_date"),
            _multiplicity("_n_demo", "_n_loc"),
        )
    )


def dim_customers(silver: dict[str, DataFrame]) -> DataFrame:
    rows = customer_rows(
        silver["crm_cust_info"], silver["erp_cust_az12"], silver["erp_loc_a101"]
    )
    keyed = dense_key(rows, "customer_key", order=["customer_id"], copies="_copies")
    return conform(keyed, GOLD_CONTRACT["dim_customers"])


def product_rows(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Current product versions with their category; ``_copies`` as for customers."""
    current = products.filter(F.col("prd_end_dt").isNull()).select(
        F.col("prd_id").alias("product_id"),
        F.col("prd_key").alias("product_number"),
        F.col("prd_nm").alias("product_name"),
        F.col("cat_id").alias("category_id"),
        F.col("prd_cost").alias("cost"),
        F.col("prd_line").alias("product_line"),
        F.col("prd_start_dt").alias("start_date"),
    )
    lookup = count_copies(categories.select("id", "cat", "subcat", "maintenance"), "_n_cat")
    return (
        count_copies(current, "_n_prd")
        .join(lookup, F.col("category_id") == F.col("id"), "left")
        .withColumnsRenamed({"cat": "category", "subcat": "subcategory"})
        .withColumn("_copies", _multiplicity("_n_prd", "_n_cat"))
        .drop("id", "_n_prd", "_n_cat")
    )


def dim_products(silver: dict[str, DataFrame]) -> DataFrame:
    rows = product_rows(silver["crm_prd_info"], silver["erp_px_cat_g1v2"])
    keyed = dense_key(
        rows, "product_key", order=["start_date", "product_number"], copies="_copies"
    )
    return conform(keyed, GOLD_CONTRACT["dim_products"])


def fact_sales(
    sales: DataFrame,
    products: DataFrame,
    customers: DataFrame,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Order lines with the surrogate keys of the finished dimensions, null where unmatched.

    Pass stored dimensions: their two looked-up columns are measured first, and only what is
    within ``broadcast_bytes`` is copied to the executors. Otherwise the lines are shuffled on the
    natural key, with skewed partitions split.
    """
    product_keys, customer_keys = broadcast_if_small(
        products.select("product_key", "product_number"),
        customers.select("customer_key", "customer_id"),
        limit=broadcast_bytes,
    )
    joined = sales.join(
        product_keys, F.col("sls_prd_key") == F.col("product_number"), "left"
    ).join(customer_keys, F.col("sls_cust_id") == F.col("customer_id"), "left")
    # Silver column names and the Gold names they get.
    named = joined.withColumnsRenamed(
        {
            "sls_ord_num": "order_number",
            "sls_order_dt": "order_date",
            "sls_ship_dt": "ship_date",
            "sls_due_dt": "due_date",
            "sls_sales": "sales_amount",
            "sls_quantity": "quantity",
            "sls_price": "price",
        }
    )
    return conform(named, GOLD_CONTRACT["fact_sales"])
