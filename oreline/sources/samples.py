"""The six extracts, reshaped from the order-processing test tables.

Every defect the cleansing rules deal with is put in by a rule on a key, so the rows grow with the
tables: change histories, padded and mixed-case codes, compound keys, unusable dates, missing, zero,
negative and wrong amounts, prefixed and hyphenated keys, and unmatched rows on every join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_CUSTOMER_ID = "cast(11000 + c_custkey as string)"
_PADDED_ID = f"lpad({_CUSTOMER_ID}, 8, '0')"


# Columns in use; a declared schema saves the job that would read it from the files.
_SCHEMAS = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string",
    "part": "p_partkey long, p_name string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long",
    "lineitem": "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_shipdate timestamp_ntz",
}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")


def crm_cust_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _read(spark, sf_dir, "customer")
    events = customers.selectExpr("*", "explode(array(0, 1)) as v")
    return events.where("v = 0 or c_custkey % 5 = 0").selectExpr(
        f"case when c_custkey % 97 = 96 then '' else {_CUSTOMER_ID} end as cst_id",
        f"'AW' || {_PADDED_ID} as cst_key",
        "if(c_custkey % 7 = 3, char(9) || char(160), '  ') || c_mktsegment || ' ' as cst_firstname",
        "c_name || '  ' as cst_lastname",
        "get(array('S', ' m', 'M ', 's', ''), cast(c_custkey % 5 as int)) as cst_marital_status",
        # Every fifth changed customer has both events on one day, with different genders.
        "get(array('M', 'f ', ' F', ''), cast((c_custkey + if(c_custkey % 25 = 5, v, 0)) % 4 as int))"
        " as cst_gndr",
        "'2025-' || lpad(cast(1 + (c_custkey + if(c_custkey % 25 = 5, 0, 3 * v)) % 12 as string), 2, '0') || '-'"
        " || lpad(cast(1 + c_custkey % 28 as string), 2, '0') as cst_create_date",
    )


def crm_prd_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "part")
    versions = parts.selectExpr("*", "explode(sequence(0, cast(p_partkey % 3 as int))) as v")
    return versions.selectExpr(
        "cast(p_partkey * 10 + v as string) as prd_id",
        "substr(p_type, 1, 2) || '-B' || cast(p_size % 10 as string) || '-P'"
        " || lpad(cast(p_partkey as string), 6, '0') as prd_key",
        "p_name as prd_nm",
        "case when p_partkey % 11 = 0 then ''"
        " else cast(cast(p_retailprice as decimal(10, 2)) as string) end as prd_cost",
        "get(array('R ', 'm', 'S', ' T', '', 'X'), cast(p_partkey % 6 as int)) as prd_line",
        "cast(2011 + v as string) || '-07-01' as prd_start_dt",
        "case when v = 0 then '' else cast(2010 + v as string) || '-12-28' end as prd_end_dt",
    )


def crm_sales_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey",
        "l_partkey",
        "cast(l_shipdate as date) as ship",
        "cast(l_quantity as bigint) as q",
        "cast(floor(l_extendedprice / l_quantity) as bigint) as p",
        "(l_orderkey * 7 + l_linenumber) % 20 as k",
    )
    orders = _read(spark, sf_dir, "orders").selectExpr("o_orderkey as l_orderkey", "o_custkey")
    # Two large tables on any real scale: always a shuffled join, also while orders is still small.
    return lines.join(orders.hint("merge"), "l_orderkey").selectExpr(
        "'SO' || cast(l_orderkey as string) as sls_ord_num",
        "if(l_partkey % 199 = 198, 'PX', 'P') || lpad(cast(l_partkey as string), 6, '0')"
        " as sls_prd_key",
        "cast(11000 + o_custkey as string) as sls_cust_id",
        "case when l_orderkey % 50 = 0 then '0' when l_orderkey % 53 = 0 then '5489'"
        " else replace(cast(date_add(ship, if(l_orderkey % 41 = 0, 3, -7)) as string), '-', '')"
        " end as sls_order_dt",
        "replace(cast(ship as string), '-', '') as sls_ship_dt",
        "replace(cast(date_add(ship, 5) as string), '-', '') as sls_due_dt",
        "case when k in (3, 6) then '' when k in (4, 7) then cast(-q * p as string)"
        " else cast(q * p + if(k = 5, 7, 0) as string) end as sls_sales",
        "cast(q as string) as sls_quantity",
        "case when k in (0, 6, 7) then '' when k = 1 then '0'"
        " else cast(if(k = 2, -p, p) as string) end as sls_price",
    )


def erp_cust_az12(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _read(spark, sf_dir, "customer").where("c_custkey % 13 <> 12")
    return customers.selectExpr(
        f"if(c_custkey % 3 = 0, 'NAS', '') || 'AW' || {_PADDED_ID} as cid",
        "case when c_custkey % 101 = 7 then '2999-01-01'"
        " else cast(1950 + c_custkey % 50 as string) || '-'"
        " || lpad(cast(1 + c_custkey % 12 as string), 2, '0') || '-15' end as bdate",
        "get(array('Male', 'F', ' female', 'M', '', 'X', 'MALE '), cast(c_custkey % 7 as int))"
        " as gen",
    )


def erp_loc_a101(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _read(spark, sf_dir, "customer").where("c_custkey % 17 <> 16")
    nations = _read(spark, sf_dir, "nation").selectExpr("n_nationkey as c_nationkey", "n_name")
    return customers.join(nations, "c_nationkey").selectExpr(
        f"'AW-' || {_PADDED_ID} as cid",
        "coalesce(get(array('US', ' usa ', 'DE', '  '), c_nationkey % 6), ' ' || n_name) as cntry",
    )


def erp_px_cat_g1v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "part").where("not (p_type = 'PROMO' and p_size % 10 = 9)")
    return parts.selectExpr(
        "substr(p_type, 1, 2) || '_B' || cast(p_size % 10 as string) as id",
        "' ' || p_type as cat",
        "'Sub' || cast(p_size % 10 as string) || ' ' as subcat",
        "if(p_size % 2 = 0, 'Yes', ' No') as maintenance",
    ).distinct()


EXTRACTS = {
    "crm_cust_info": crm_cust_info,
    "crm_prd_info": crm_prd_info,
    "crm_sales_details": crm_sales_details,
    "erp_cust_az12": erp_cust_az12,
    "erp_loc_a101": erp_loc_a101,
    "erp_px_cat_g1v2": erp_px_cat_g1v2,
}


def hard_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with quantities of 0 and none, amounts that the quantity does not divide, and fractions of a cent."""
    number = "cast(substr(sls_ord_num, 3) as bigint) % 6"
    return crm_sales_details(spark, sf_dir).selectExpr(
        "sls_ord_num", "sls_prd_key", "sls_cust_id", "sls_order_dt", "sls_ship_dt", "sls_due_dt",
        f"case {number} when 2 then '100.10' when 4 then '0.015' else sls_sales end as sls_sales",
        f"case {number} when 1 then '0' when 2 then '3' when 3 then '' when 4 then '3' else sls_quantity end"
        " as sls_quantity",
        f"case {number} when 1 then '' when 2 then '' when 4 then '0.005' else sls_price end as sls_price",
    )


def hard_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product versions of which some have no start date, or the start date of another version."""
    return crm_prd_info(spark, sf_dir).selectExpr(
        "prd_id", "prd_key", "prd_nm", "prd_cost", "prd_line",
        "case cast(prd_id as bigint) % 7 when 1 then '' when 2 then '2011-07-01' else prd_start_dt end as prd_start_dt",
        "prd_end_dt",
    )


def hard_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demographics in which some keys are repeated, with other values and as plain copies."""
    people = erp_cust_az12(spark, sf_dir)
    other = people.where("cid like '%5'").selectExpr("cid", "'1960-05-05' as bdate", "'F' as gen")
    return people.unionByName(other).unionByName(people.where("cid like '%25'"))


def hard_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations in which some keys are repeated."""
    places = erp_loc_a101(spark, sf_dir)
    return places.unionByName(places.where("cid like '%15'").selectExpr("cid", "'DE' as cntry"))


HARD_EXTRACTS = {
    "crm_sales_details": hard_sales,
    "crm_prd_info": hard_versions,
    "erp_cust_az12": hard_people,
    "erp_loc_a101": hard_places,
}
