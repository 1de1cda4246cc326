"""Tables, columns, contract types and approved value sets of the three layers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Layer names, the load-time column and the label of an unknown code.
LAYERS = ("bronze", "silver", "gold")
LOAD_STAMP = "dwh_create_date"
UNKNOWN = "n/a"


@dataclass(frozen=True)
class Source:
    """One CSV extract and the Bronze table it lands in."""

    file: str
    table: str
    columns: tuple[str, ...]
    date_formats: tuple[str, ...] = ("iso",)  # of its date columns, tried in this order


# Extract names, table names and column names of the two source systems.
SOURCES: tuple[Source, ...] = (
    Source(
        "cust_info.csv",
        "crm_cust_info",
        (
            "cst_id",
            "cst_key",
            "cst_firstname",
            "cst_lastname",
            "cst_marital_status",
            "cst_gndr",
            "cst_create_date",
        ),
    ),
    Source(
        "prd_info.csv",
        "crm_prd_info",
        ("prd_id", "prd_key", "prd_nm", "prd_cost", "prd_line", "prd_start_dt", "prd_end_dt"),
    ),
    Source(
        "sales_details.csv",
        "crm_sales_details",
        (
            "sls_ord_num",
            "sls_prd_key",
            "sls_cust_id",
            "sls_order_dt",
            "sls_ship_dt",
            "sls_due_dt",
            "sls_sales",
            "sls_quantity",
            "sls_price",
        ),
    ),
    Source("CUST_AZ12.csv", "erp_cust_az12", ("cid", "bdate", "gen")),
    Source("LOC_A101.csv", "erp_loc_a101", ("cid", "cntry")),
    Source("PX_CAT_G1V2.csv", "erp_px_cat_g1v2", ("id", "cat", "subcat", "maintenance")),
)
SOURCE_TABLES = tuple(source.table for source in SOURCES)
DATE_FORMATS = {source.table: source.date_formats for source in SOURCES}

# The documented star-schema contract.
_MONEY = T.DecimalType(10, 2)
GOLD_CONTRACT: dict[str, T.StructType] = {
    "dim_customers": (
        T.StructType()
        .add("customer_key", T.LongType())
        .add("customer_id", T.StringType())
        .add("customer_number", T.StringType())
        .add("first_name", T.StringType())
        .add("last_name", T.StringType())
        .add("country", T.StringType())
        .add("marital_status", T.StringType())
        .add("gender", T.StringType())
        .add("birthdate", T.DateType())
        .add("create_date", T.DateType())
    ),
    "dim_products": (
        T.StructType()
        .add("product_key", T.LongType())
        .add("product_id", T.StringType())
        .add("product_number", T.StringType())
        .add("product_name", T.StringType())
        .add("category_id", T.StringType())
        .add("category", T.StringType())
        .add("subcategory", T.StringType())
        .add("maintenance", T.StringType())
        .add("cost", _MONEY)
        .add("product_line", T.StringType())
        .add("start_date", T.DateType())
    ),
    "fact_sales": (
        T.StructType()
        .add("order_number", T.StringType())
        .add("product_key", T.LongType())
        .add("customer_key", T.LongType())
        .add("order_date", T.DateType())
        .add("ship_date", T.DateType())
        .add("due_date", T.DateType())
        .add("sales_amount", _MONEY)
        .add("quantity", T.IntegerType())
        .add("price", _MONEY)
    ),
}

# Approved sets per coded Silver column; None means the set is open.
APPROVED_VALUES: dict[tuple[str, str], tuple[str, ...] | None] = {
    ("crm_cust_info", "cst_gndr"): ("Male", "Female", UNKNOWN),
    ("crm_cust_info", "cst_marital_status"): ("Single", "Married", UNKNOWN),
    ("crm_prd_info", "prd_line"): ("Road", "Mountain", "Other Sales", "Touring", UNKNOWN),
    ("erp_loc_a101", "cntry"): None,
}
