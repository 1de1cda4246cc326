"""Bronze to Silver, one function per table. Only the two histories shuffle."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreline.functions.codes import (
    CRM_GENDER,
    ERP_GENDER,
    MARITAL_STATUS,
    PRODUCT_LINE,
    country_name,
    label,
    past_or_null,
)
from oreline.functions.parsing import parse_compact_date, parse_date, parse_moment, parse_number
from oreline.functions.text import (
    drop_prefix,
    first_chars,
    is_blank,
    remove,
    strip,
    swap,
    without_first,
)
from oreline.operators.latest import latest_per_key
from oreline.operators.repair import repair_sales
from oreline.operators.versions import end_date_versions
from oreline.schemas import DATE_FORMATS


def as_of_column(as_of: date | None) -> Column:
    return F.current_date() if as_of is None else F.lit(as_of)


Formats = tuple[str, ...]


def crm_cust_info(
    bronze: DataFrame, dates: Formats = DATE_FORMATS["crm_cust_info"]
) -> DataFrame:
    """Latest change event of every identified customer, names trimmed, codes spelled out."""
    latest = latest_per_key(
        bronze.filter(~is_blank(F.col("cst_id"))),
        key="cst_id",
        recency=parse_moment(F.col("cst_create_date"), dates),
        ties=[c for c in bronze.columns if c != "cst_id"],
    )
    return latest.select(
        "cst_id",
        "cst_key",
        strip(F.col("cst_firstname")).alias("cst_firstname"),
        strip(F.col("cst_lastname")).alias("cst_lastname"),
        label(F.col("cst_marital_status"), MARITAL_STATUS).alias("cst_marital_status"),
        label(F.col("cst_gndr"), CRM_GENDER).alias("cst_gndr"),
        parse_date(F.col("cst_create_date"), dates).alias("cst_create_date"),
    )


def split_product_key(key: Column) -> tuple[Column, Column]:
    """Category id (first five characters, underscored) and the part after the delimiter."""
    return swap(first_chars(key, 5), "-", "_"), without_first(key, 6)


def crm_prd_info(bronze: DataFrame, dates: Formats = DATE_FORMATS["crm_prd_info"]) -> DataFrame:
    """Product versions with split key, default cost, line name and recomputed end date."""
    category, number = split_product_key(F.col("prd_key"))
    versions = bronze.select(
        "prd_id",
        number.alias("prd_key"),
        "prd_nm",
        F.coalesce(parse_number(F.col("prd_cost")), F.lit(0.0)).alias("prd_cost"),
        label(F.col("prd_line"), PRODUCT_LINE).alias("prd_line"),
        parse_date(F.col("prd_start_dt"), dates).alias("prd_start_dt"),
        F.lit(None).cast("date").alias("prd_end_dt"),
        category.alias("cat_id"),
    )
    return end_date_versions(versions, key="prd_key", start="prd_start_dt", end="prd_end_dt")


def crm_sales_details(bronze: DataFrame) -> DataFrame:
    """Order lines with real dates and repaired price and amount."""
    dates = ("sls_order_dt", "sls_ship_dt", "sls_due_dt")
    numbers = ("sls_sales", "sls_quantity", "sls_price")
    typed = bronze.select(
        "sls_ord_num",
        "sls_prd_key",
        "sls_cust_id",
        *[parse_compact_date(F.col(c)).alias(c) for c in dates],
        *[parse_number(F.col(c)).alias(c) for c in numbers],
    )
    return repair_sales(typed, sales="sls_sales", quantity="sls_quantity", price="sls_price")


def erp_cust_az12(
    bronze: DataFrame, as_of: date | None = None, dates: Formats = DATE_FORMATS["erp_cust_az12"]
) -> DataFrame:
    """Demographics keyed like the CRM, without birthdates after ``as_of`` (today)."""
    return bronze.select(
        drop_prefix(F.col("cid"), "NAS").alias("cid"),
        past_or_null(parse_date(F.col("bdate"), dates), as_of_column(as_of)).alias("bdate"),
        label(F.col("gen"), ERP_GENDER).alias("gen"),
    )


def erp_loc_a101(bronze: DataFrame) -> DataFrame:
    """Locations keyed like the CRM, one name per country."""
    return bronze.select(
        remove(F.col("cid"), "-").alias("cid"), country_name(F.col("cntry")).alias("cntry")
    )


def erp_px_cat_g1v2(bronze: DataFrame) -> DataFrame:
    """Categories with trimmed texts; the id is left as delivered."""
    texts = ("cat", "subcat", "maintenance")
    return bronze.select("id", *[strip(F.col(c)).alias(c) for c in texts])


def silver_builders(as_of: date | None = None) -> dict[str, Callable[[DataFrame], DataFrame]]:
    return {
        "crm_cust_info": crm_cust_info,
        "crm_prd_info": crm_prd_info,
        "crm_sales_details": crm_sales_details,
        "erp_cust_az12": lambda bronze: erp_cust_az12(bronze, as_of),
        "erp_loc_a101": erp_loc_a101,
        "erp_px_cat_g1v2": erp_px_cat_g1v2,
    }

