"""Profiles of the Bronze tables: what is wrong with the data before any rule is applied.

Every profile is a tidy table (``metric``, ``value``, ``n``): a count when ``value`` is null, else the
number of rows with that value. Nothing is collected, so an unexpectedly wide domain stays a table.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreline.functions.logic import differs, holds
from oreline.functions.parsing import (
    parse_compact_date,
    parse_moment,
    parse_number,
    unreadable_date,
)
from oreline.functions.text import first_chars, is_blank
from oreline.operators.counts import (
    count_if,
    duplicates,
    flag_and_value_rows,
    key_counts,
    metric_rows,
    value_rows,
)
from oreline.schemas import DATE_FORMATS

PREFIX_SAMPLE = 5


def profile_customers(bronze: DataFrame) -> DataFrame:
    """Repeated and blank customer ids, raw gender and marital codes."""
    dates = DATE_FORMATS["crm_cust_info"]
    ids = metric_rows(
        key_counts(bronze, "cst_id"),
        {
            "duplicate_cst_id": duplicates(),
            "blank_cst_id": F.sum(F.when(is_blank(F.col("key")), F.col("n"))),
        },
    )
    found = flag_and_value_rows(
        bronze,
        {"unreadable_create_date": unreadable_date(F.col("cst_create_date"), dates)},
        {c: F.col(c) for c in ("cst_gndr", "cst_marital_status")},
    )
    return ids.unionByName(found)


def profile_products(bronze: DataFrame) -> DataFrame:
    """A sample of key prefixes, unreadable costs, raw line codes."""
    dates = DATE_FORMATS["crm_prd_info"]
    found = flag_and_value_rows(
        bronze,
        {
            "missing_cost": parse_number(F.col("prd_cost")).isNull(),
            "unreadable_start_date": unreadable_date(F.col("prd_start_dt"), dates),
        },
        {"key_prefix": first_chars(F.col("prd_key"), 5), "prd_line": F.col("prd_line")},
    )
    place = F.row_number().over(Window.partitionBy("metric").orderBy("value"))
    sampled = (F.col("metric") != "key_prefix") | (place <= PREFIX_SAMPLE)
    return found.withColumn("_kept", sampled).filter("_kept").drop("_kept")


def profile_sales(bronze: DataFrame) -> DataFrame:
    """Placeholder dates, amounts that do not add up, unusable prices; one pass."""
    sales, quantity, price = (
        parse_number(F.col(c)) for c in ("sls_sales", "sls_quantity", "sls_price")
    )
    return metric_rows(
        bronze,
        {
            "zero_order_date": count_if(F.col("sls_order_dt") == "0"),
            "unreadable_order_date": count_if(
                parse_compact_date(F.col("sls_order_dt")).isNull()
            ),
            "amount_mismatch": count_if(differs(sales, quantity * price)),
            "bad_price": count_if(price.isNull() | holds(price <= 0)),
        },
    )


def _now(as_of: datetime | None) -> Column:
    now = F.current_timestamp() if as_of is None else F.lit(as_of)
    return now.cast("timestamp_ntz")


def profile_demographics(bronze: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Prefixed ids, birthdates in the future, raw gender codes."""
    dates = DATE_FORMATS["erp_cust_az12"]
    return flag_and_value_rows(
        bronze,
        {
            "nas_prefix": F.col("cid").startswith("NAS"),
            "future_bdate": parse_moment(F.col("bdate"), dates) > _now(as_of),
            "unreadable_bdate": unreadable_date(F.col("bdate"), dates),
        },
        {"gen": F.col("gen")},
    )


def profile_locations(bronze: DataFrame) -> DataFrame:
    return value_rows(bronze, ["cntry"])


def profile_categories(bronze: DataFrame) -> DataFrame:
    """Nulls per column, and blanks, which is what a missing CSV field becomes."""
    counts = metric_rows(
        bronze,
        {
            **{f"null_{c}": count_if(F.col(c).isNull()) for c in bronze.columns},
            **{f"blank_{c}": count_if(F.col(c) == "") for c in bronze.columns},
        },
    )
    return counts


PROFILES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "crm_cust_info": profile_customers,
    "crm_prd_info": profile_products,
    "crm_sales_details": profile_sales,
    "erp_cust_az12": profile_demographics,
    "erp_loc_a101": profile_locations,
    "erp_px_cat_g1v2": profile_categories,
}


def profile_all(bronze: dict[str, DataFrame]) -> DataFrame:
    """All profiles, with the table they belong to."""
    parts = [
        profile(bronze[table]).select(F.lit(table).alias("table"), "metric", "value", "n")
        for table, profile in PROFILES.items()
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
