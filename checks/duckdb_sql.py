"""Equivalent statements for DuckDB over the test tables, written apart from the Spark plans."""

from __future__ import annotations

# The six extracts, as given in FIXTURES.md.
EXTRACTS = {
    "crm_cust_info": """
select case when c_custkey % 97 = 96 then '' else cast(11000+c_custkey as string) end as cst_id,
 'AW' || lpad(cast(11000+c_custkey as string),8,'0') as cst_key,
 case when c_custkey % 7 = 3 then chr(9) || chr(160) else '  ' end || c_mktsegment || ' ' as cst_firstname, c_name || '  ' as cst_lastname,
 case c_custkey % 5 when 0 then 'S' when 1 then ' m' when 2 then 'M ' when 3 then 's' else '' end as cst_marital_status,
 case (c_custkey + case when c_custkey % 25 = 5 then v else 0 end) % 4 when 0 then 'M' when 1 then 'f ' when 2 then ' F' else '' end as cst_gndr,
 '2025-' || lpad(cast(1+(c_custkey+case when c_custkey % 25 = 5 then 0 else 3*v end) % 12 as string),2,'0') || '-' || lpad(cast(1+c_custkey % 28 as string),2,'0') as cst_create_date
 from customer cross join (select 0 as v union all select 1 as v) vv where v = 0 or c_custkey % 5 = 0
""",
    "crm_prd_info": """
select cast(p_partkey*10+v as string) as prd_id,
 substr(p_type,1,2) || '-B' || cast(p_size % 10 as string) || '-P' || lpad(cast(p_partkey as string),6,'0') as prd_key,
 p_name as prd_nm,
 case when p_partkey % 11 = 0 then '' else cast(cast(p_retailprice as decimal(10,2)) as string) end as prd_cost,
 case p_partkey % 6 when 0 then 'R ' when 1 then 'm' when 2 then 'S' when 3 then ' T' when 4 then '' else 'X' end as prd_line,
 cast(2011+v as string) || '-07-01' as prd_start_dt,
 case when v = 0 then '' else cast(2010+v as string) || '-12-28' end as prd_end_dt
 from part cross join (select 0 as v union all select 1 as v union all select 2 as v) vv where v <= p_partkey % 3
""",
    "crm_sales_details": """
select 'SO' || cast(l_orderkey as string) as sls_ord_num,
 case when l_partkey % 199 = 198 then 'PX' else 'P' end || lpad(cast(l_partkey as string),6,'0') as sls_prd_key,
 cast(11000+o_custkey as string) as sls_cust_id,
 case when l_orderkey % 50 = 0 then '0' when l_orderkey % 53 = 0 then '5489'
      else replace(substr(cast(case when l_orderkey % 41 = 0 then l_shipdate + interval '3' day else l_shipdate - interval '7' day end as string),1,10),'-','') end as sls_order_dt,
 replace(substr(cast(l_shipdate as string),1,10),'-','') as sls_ship_dt,
 replace(substr(cast(l_shipdate + interval '5' day as string),1,10),'-','') as sls_due_dt,
 case k when 3 then '' when 6 then '' when 4 then cast(-q*p as string) when 7 then cast(-q*p as string) when 5 then cast(q*p+7 as string) else cast(q*p as string) end as sls_sales,
 cast(q as string) as sls_quantity,
 case k when 0 then '' when 6 then '' when 7 then '' when 1 then '0' when 2 then cast(-p as string) else cast(p as string) end as sls_price
 from (select *, cast(l_quantity as bigint) as q, cast(floor(l_extendedprice/l_quantity) as bigint) as p, (l_orderkey*7+l_linenumber) % 20 as k from lineitem) l join orders on l_orderkey = o_orderkey
""",
    "erp_cust_az12": """
select case when c_custkey % 3 = 0 then 'NAS' else '' end || 'AW' || lpad(cast(11000+c_custkey as string),8,'0') as cid,
 case when c_custkey % 101 = 7 then '2999-01-01' else cast(1950+c_custkey % 50 as string) || '-' || lpad(cast(1+c_custkey % 12 as string),2,'0') || '-15' end as bdate,
 case c_custkey % 7 when 0 then 'Male' when 1 then 'F' when 2 then ' female' when 3 then 'M' when 4 then '' when 5 then 'X' else 'MALE ' end as gen
 from customer where c_custkey % 13 <> 12
""",
    "erp_loc_a101": """
select 'AW-' || lpad(cast(11000+c_custkey as string),8,'0') as cid,
 case when c_nationkey % 6 = 0 then 'US' when c_nationkey % 6 = 1 then ' usa ' when c_nationkey % 6 = 2 then 'DE' when c_nationkey % 6 = 3 then '  ' else ' ' || n_name end as cntry
 from customer join nation on c_nationkey = n_nationkey where c_custkey % 17 <> 16
""",
    "erp_px_cat_g1v2": """
select distinct substr(p_type,1,2) || '_B' || cast(p_size % 10 as string) as id, ' ' || p_type as cat, 'Sub' || cast(p_size % 10 as string) || ' ' as subcat, case when p_size % 2 = 0 then 'Yes' else ' No' end as maintenance
 from part where not (p_type = 'PROMO' and p_size % 10 = 9)
""",
}

SILVER = {
    "crm_cust_info": """
select cst_id, cst_key, trim(cst_firstname, ' ' || chr(9) || chr(160)) as cst_firstname,
 trim(cst_lastname) as cst_lastname,
 case upper(trim(cst_marital_status)) when 'S' then 'Single' when 'M' then 'Married'
  else 'n/a' end as cst_marital_status,
 case upper(trim(cst_gndr)) when 'M' then 'Male' when 'F' then 'Female' else 'n/a' end as cst_gndr,
 try_cast(cst_create_date as date) as cst_create_date
from b_crm_cust_info where cst_id <> ''
qualify row_number() over (partition by cst_id
 order by try_cast(cst_create_date as date) desc nulls last, cst_key, cst_firstname, cst_lastname,
  cst_marital_status, cst_gndr, cst_create_date) = 1
""",
    "crm_prd_info": """
select prd_id, prd_key, prd_nm, prd_cost, prd_line, prd_start_dt,
 cast(lead(prd_start_dt) over (partition by prd_key order by prd_start_dt nulls last, prd_id)
  - interval 1 day as date) as prd_end_dt, cat_id
from (select prd_id, substr(prd_key, 7) as prd_key, prd_nm,
  coalesce(try_cast(nullif(prd_cost, '') as double), 0) as prd_cost,
  case upper(trim(prd_line)) when 'R' then 'Road' when 'M' then 'Mountain' when 'S' then 'Other Sales'
   when 'T' then 'Touring' else 'n/a' end as prd_line,
  try_cast(prd_start_dt as date) as prd_start_dt,
  replace(substr(prd_key, 1, 5), '-', '_') as cat_id
 from b_crm_prd_info)
""",
    "crm_sales_details": """
select sls_ord_num, sls_prd_key, sls_cust_id, sls_order_dt, sls_ship_dt, sls_due_dt,
 case when sls_sales is null or sls_sales < 0 or expected is null or sls_sales <> expected
  then expected else sls_sales end as sls_sales, sls_quantity, sls_price
from (select *, sls_quantity * abs(sls_price) as expected
 from (select sls_ord_num, sls_prd_key, sls_cust_id, sls_order_dt, sls_ship_dt, sls_due_dt,
   sls_sales, sls_quantity, case when sls_price is null or sls_price <= 0
    then sls_sales / nullif(sls_quantity, 0) else sls_price end as sls_price
  from (select sls_ord_num, sls_prd_key, sls_cust_id,
    case when length(sls_order_dt) = 8 then cast(try_strptime(sls_order_dt, '%Y%m%d') as date) end
     as sls_order_dt,
    case when length(sls_ship_dt) = 8 then cast(try_strptime(sls_ship_dt, '%Y%m%d') as date) end
     as sls_ship_dt,
    case when length(sls_due_dt) = 8 then cast(try_strptime(sls_due_dt, '%Y%m%d') as date) end
     as sls_due_dt,
    try_cast(nullif(sls_sales, '') as double) as sls_sales,
    try_cast(nullif(sls_quantity, '') as double) as sls_quantity,
    try_cast(nullif(sls_price, '') as double) as sls_price
   from b_crm_sales_details)))
""",
    "erp_cust_az12": """
select case when starts_with(cid, 'NAS') then substr(cid, 4) else cid end as cid,
 case when try_cast(bdate as date) <= date '2026-01-01' then try_cast(bdate as date) end as bdate,
 case upper(trim(gen)) when 'M' then 'Male' when 'MALE' then 'Male' when 'F' then 'Female'
  when 'FEMALE' then 'Female' else 'n/a' end as gen
from b_erp_cust_az12
""",
    "erp_loc_a101": """
select replace(cid, '-', '') as cid,
 case when upper(trim(cntry)) in ('US', 'USA') then 'United States'
  when upper(trim(cntry)) = 'DE' then 'Germany' when trim(cntry) = '' then 'n/a'
  else trim(cntry) end as cntry
from b_erp_loc_a101
""",
    "erp_px_cat_g1v2": """
select id, trim(cat) as cat, trim(subcat) as subcat, trim(maintenance) as maintenance
from b_erp_px_cat_g1v2
""",
}

GOLD = {
    "dim_customers": """
select cast(row_number() over (order by cst_id, cst_key, bdate, cntry) as bigint) as customer_key,
 cst_id as customer_id, cst_key as customer_number, cst_firstname as first_name,
 cst_lastname as last_name, cntry as country, cst_marital_status as marital_status,
 case when cst_gndr <> 'n/a' then cst_gndr else coalesce(gen, 'n/a') end as gender,
 bdate as birthdate, cst_create_date as create_date
from s_crm_cust_info c left join s_erp_cust_az12 d on cst_key = d.cid
 left join s_erp_loc_a101 l on cst_key = l.cid
""",
    "dim_products": """
select cast(row_number() over (order by prd_start_dt nulls last, prd_key, prd_id) as bigint)
  as product_key, prd_id as product_id, prd_key as product_number, prd_nm as product_name,
 cat_id as category_id, cat as category, subcat as subcategory, maintenance,
 cast(prd_cost as decimal(10, 2)) as cost, prd_line as product_line, prd_start_dt as start_date
from s_crm_prd_info left join s_erp_px_cat_g1v2 on cat_id = id where prd_end_dt is null
""",
    "fact_sales": """
select sls_ord_num as order_number, product_key, customer_key, sls_order_dt as order_date,
 sls_ship_dt as ship_date, sls_due_dt as due_date,
 cast(sls_sales as decimal(10, 2)) as sales_amount, cast(sls_quantity as integer) as quantity,
 cast(sls_price as decimal(10, 2)) as price
from s_crm_sales_details left join g_dim_products on sls_prd_key = product_number
 left join g_dim_customers on sls_cust_id = customer_id
""",
}

# Every named query in the order its inputs need; only the ones a statement uses are put before it.
_PARTS = (
    [(f"b_{name}", sql) for name, sql in EXTRACTS.items()]
    + [(f"s_{name}", sql) for name, sql in SILVER.items()]
    + [(f"g_{name}", sql) for name, sql in GOLD.items()]
)


def with_inputs(statement: str, extracts: dict[str, str] | None = None) -> str:
    """Put the queries ``statement`` refers to, directly or not, in front of it; ``extracts`` replace the usual ones."""
    text, used = statement, []
    changed = {f"b_{name}": sql for name, sql in (extracts or {}).items()}
    for name, sql in reversed(_PARTS):
        sql = changed.get(name, sql)
        if name in text:
            used.append((name, sql))
            text += sql
    ctes = ",\n".join(f"{name} as ({sql.strip()})" for name, sql in reversed(used))
    return f"with {ctes}\n{statement.strip()}"


def _select_all(name: str) -> str:
    return with_inputs(f"select * from {name}")


def _metrics(table: str, metrics: dict[str, str]) -> str:
    return "\nunion all ".join(
        f"select '{m}' as metric, cast(null as varchar) as value, "
        f"cast(coalesce({e}, 0) as bigint) as n from {table}"
        for m, e in metrics.items()
    )


def _values(table: str, column: str) -> str:
    return (
        f"select '{column}' as metric, {column} as value, count(*) as n from {table} "
        f"group by {column}"
    )


def _rule(rule: str, violations: str, table: str, checked: str = "count(*)") -> str:
    return (
        f"select '{rule}' as rule, cast(coalesce({violations}, 0) as bigint) as violations, "
        f"cast({checked} as bigint) as checked from {table}"
    )


def _unreadable(column: str) -> str:
    return f"trim({column}) <> '' and try_cast(trim({column}) as date) is null"


def _count_where(condition: str) -> str:
    return f"sum(case when {condition} then 1 else 0 end)"


_NUMBERS = """(select try_cast(nullif(sls_sales, '') as double) as s,
  try_cast(nullif(sls_quantity, '') as double) as q, try_cast(nullif(sls_price, '') as double) as p,
  sls_order_dt from b_crm_sales_details) x"""

_MISMATCH = "coalesce(sls_sales <> sls_quantity * sls_price, true)"
_BAD_AMOUNT = f"{_MISMATCH} or sls_quantity <= 0 or sls_price <= 0"
_DATE_ORDER = "sls_order_dt > sls_due_dt or sls_order_dt > sls_ship_dt"

UNIQUE_KEYS = "\nunion all ".join(
    [
        _rule("duplicate_cst_id", "count(*) - count(distinct cst_id)", "s_crm_cust_info"),
        _rule("duplicate_prd_key", "count(*) - count(distinct prd_key)", "s_crm_prd_info"),
        _rule(
            "several_current_versions",
            "sum(case when c > 1 then c - 1 else 0 end)",
            "(select prd_key, count(*) as n, "
            "count(*) filter (where prd_end_dt is null) as c "
            "from s_crm_prd_info group by prd_key) v",
            "sum(n)",
        ),
    ]
)
_DOMAINS = "\nunion all ".join(
    f"select '{table}' as \"table\", '{column}' as \"column\", {column} as value, count(*) as n, "
    f"{verdict} as approved from s_{table} group by {column}"
    for table, column, verdict in (
        ("crm_cust_info", "cst_gndr", "cst_gndr in ('Male', 'Female', 'n/a')"),
        (
            "crm_cust_info",
            "cst_marital_status",
            "cst_marital_status in ('Single', 'Married', 'n/a')",
        ),
        (
            "crm_prd_info",
            "prd_line",
            "prd_line in ('Road', 'Mountain', 'Other Sales', 'Touring', 'n/a')",
        ),
        ("erp_loc_a101", "cntry", "cast(null as boolean)"),
    )
)
UNAPPROVED = (
    "select 'unapproved_value' as rule, cast(coalesce(sum(case when not approved then n end), 0) "
    f"as bigint) as violations, cast(sum(n) as bigint) as checked from ({_DOMAINS}) d "
    "where approved is not null"
)
DATE_ORDER = _rule("order_after_ship_or_due", _count_where(_DATE_ORDER), "s_crm_sales_details")
SALES_AMOUNT = "\nunion all ".join(
    [
        _rule("amount_mismatch", _count_where(_MISMATCH), "s_crm_sales_details"),
        _rule("bad_amount_or_factor", _count_where(_BAD_AMOUNT), "s_crm_sales_details"),
    ]
)
ORPHAN_CUSTOMERS = _rule(
    "orphan_customer",
    _count_where("sls_cust_id not in (select cst_id from s_crm_cust_info)"),
    "s_crm_sales_details",
)
ORPHAN_PRODUCTS = _rule(
    "orphan_product",
    _count_where("sls_prd_key not in (select prd_key from s_crm_prd_info)"),
    "s_crm_sales_details",
)
RECONCILE = (
    "select 'fact_rows_differ' as rule, cast(abs(l.n - f.n) as bigint) as violations, "
    "cast(l.n as bigint) as checked from (select count(*) as n from s_crm_sales_details) l, "
    "(select count(*) as n from g_fact_sales) f"
)
MISSING_KEYS = _rule(
    "missing_surrogate_key",
    _count_where("customer_key is null or product_key is null"),
    "g_fact_sales",
)
GOLD_AMOUNT = _rule(
    "gold_amount_mismatch",
    _count_where("coalesce(sales_amount <> quantity * price, true)"),
    "g_fact_sales",
)


_PLACES = {
    "duplicate_cst_id": ("silver", "crm_cust_info"),
    "duplicate_prd_key": ("silver", "crm_prd_info"),
    "several_current_versions": ("silver", "crm_prd_info"),
    "unapproved_value": ("silver", "all coded columns"),
    "fact_rows_differ": ("gold", "fact_sales"),
    "missing_surrogate_key": ("gold", "fact_sales"),
    "gold_amount_mismatch": ("gold", "fact_sales"),
}


def _place(part: int, otherwise: str) -> str:
    cases = " ".join(f"when '{rule}' then '{p[part]}'" for rule, p in _PLACES.items())
    return f"case rule {cases} else '{otherwise}' end"


_ALL_RULES = "\nunion all ".join(
    [
        UNIQUE_KEYS,
        UNAPPROVED,
        DATE_ORDER,
        SALES_AMOUNT,
        ORPHAN_CUSTOMERS,
        ORPHAN_PRODUCTS,
        RECONCILE,
        MISSING_KEYS,
        GOLD_AMOUNT,
    ]
)
QUALITY_REPORT = (
    f"select {_place(0, 'silver')} as layer, {_place(1, 'crm_sales_details')} as \"table\", "
    "rule, violations, checked, case when rule = 'duplicate_prd_key' then 'info' "
    f"when violations = 0 then 'ok' else 'failed' end as status from ({_ALL_RULES}) r"
)
BRONZE_COUNTS = "\nunion all ".join(
    f"select '{name}' as \"table\", count(*) as source_rows, count(*) as loaded_rows, "
    f"cast(0 as bigint) as difference from b_{name}"
    for name in EXTRACTS
)
LOAD_REPORT = "\nunion all ".join(
    f"select '{name}' as \"table\", count(*) as reported_rows, count(*) as stored_rows from s_{name}"
    for name in EXTRACTS
)
SILVER_LOAD_TIMES = "\nunion all ".join(
    f"select '{name}' as \"table\", count(*) as \"rows\", cast(0 as bigint) as without_time, "
    f"cast(1 as bigint) as load_times from s_{name}"
    for name in EXTRACTS
)
SALES_BY_COUNTRY = """
select country, cast(sum(sales_amount) as decimal(38, 2)) as sales_amount
from g_fact_sales f join g_dim_customers c on f.customer_key = c.customer_key
where country is not null group by country
"""
_N = "cast(substr(sls_ord_num, 3) as bigint) % 6"
HARD_EXTRACTS = {
    "crm_sales_details": f"""
select * replace (case {_N} when 2 then '100.10' when 4 then '0.015' else sls_sales end as sls_sales,
 case {_N} when 1 then '0' when 2 then '3' when 3 then '' when 4 then '3' else sls_quantity end as sls_quantity,
 case {_N} when 1 then '' when 2 then '' when 4 then '0.005' else sls_price end as sls_price)
from ({EXTRACTS["crm_sales_details"]})
""",
    "crm_prd_info": f"""
select * replace (case cast(prd_id as bigint) % 7 when 1 then '' when 2 then '2011-07-01' else prd_start_dt end as prd_start_dt)
from ({EXTRACTS["crm_prd_info"]})
""",
    "erp_cust_az12": f"""
select * from ({EXTRACTS["erp_cust_az12"]})
union all select cid, '1960-05-05', 'F' from ({EXTRACTS["erp_cust_az12"]}) where cid like '%5'
union all select * from ({EXTRACTS["erp_cust_az12"]}) where cid like '%25'
""",
    "erp_loc_a101": f"""
select * from ({EXTRACTS["erp_loc_a101"]})
union all select cid, 'DE' from ({EXTRACTS["erp_loc_a101"]}) where cid like '%15'
""",
}
HARD_CUSTOMERS = """
select cast(row_number() over (order by customer_id, customer_number, first_name, last_name, country nulls last,
  marital_status, gender, birthdate nulls last, create_date nulls last) as bigint) as customer_key, *
from (select * exclude (customer_key) from g_dim_customers)
"""
RELOADED = "\nunion all ".join(
    f"select '{name}' as \"table\", count(*) as open_rows, count(*) filter (where {half}) as reloaded_rows, "
    f"count(*) as recovered_rows from s_{name}"
    for name, half in (("erp_loc_a101", "cntry = 'Germany'"), ("erp_cust_az12", "gen = 'Male'"))
)

_PROFILES = {
    "crm_cust_info": _metrics(
        "b_crm_cust_info",
        {
            "duplicate_cst_id": "count(*) - count(distinct cst_id)",
            "blank_cst_id": _count_where("cst_id = ''"),
            "unreadable_create_date": _count_where(_unreadable("cst_create_date")),
        },
    )
    + "\nunion all "
    + _values("b_crm_cust_info", "cst_gndr")
    + "\nunion all "
    + _values("b_crm_cust_info", "cst_marital_status"),
    "crm_prd_info": _metrics(
        "b_crm_prd_info",
        {
            "missing_cost": _count_where("try_cast(nullif(prd_cost, '') as double) is null"),
            "unreadable_start_date": _count_where(_unreadable("prd_start_dt")),
        },
    )
    + "\nunion all (select 'key_prefix' as metric, substr(prd_key, 1, 5) as value, "
    "count(*) as n from b_crm_prd_info group by substr(prd_key, 1, 5) order by value limit 5)"
    + "\nunion all "
    + _values("b_crm_prd_info", "prd_line"),
    "crm_sales_details": _metrics(
        _NUMBERS,
        {
            "zero_order_date": _count_where("sls_order_dt = '0'"),
            "unreadable_order_date": _count_where(
                "length(sls_order_dt) <> 8 or try_strptime(sls_order_dt, '%Y%m%d') is null"
            ),
            "amount_mismatch": _count_where("coalesce(s <> q * p, true)"),
            "bad_price": _count_where("p is null or p <= 0"),
        },
    ),
    "erp_cust_az12": _metrics(
        "b_erp_cust_az12",
        {
            "nas_prefix": _count_where("starts_with(cid, 'NAS')"),
            "future_bdate": _count_where("try_cast(bdate as date) > date '2026-01-01'"),
            "unreadable_bdate": _count_where(_unreadable("bdate")),
        },
    )
    + "\nunion all "
    + _values("b_erp_cust_az12", "gen"),
    "erp_loc_a101": _values("b_erp_loc_a101", "cntry"),
    "erp_px_cat_g1v2": _metrics(
        "b_erp_px_cat_g1v2",
        {
            **{
                f"null_{c}": _count_where(f"{c} is null")
                for c in ("id", "cat", "subcat", "maintenance")
            },
            **{
                f"blank_{c}": _count_where(f"{c} = ''")
                for c in ("id", "cat", "subcat", "maintenance")
            },
        },
    ),
}
PROFILE_REPORT = "\nunion all ".join(
    f"select '{table}' as \"table\", metric, value, n from ({sql}) p{i}"
    for i, (table, sql) in enumerate(_PROFILES.items())
)
ORDER_KEYS = """
select cast(row_number() over (order by sls_cust_id, sls_ord_num, sls_prd_key, sls_quantity,
 sls_sales) as bigint) as line_key, sls_cust_id, sls_ord_num, sls_prd_key, sls_quantity, sls_sales
from b_crm_sales_details
"""
PARSED_SALES = """
select sls_ord_num,
 case when length(sls_order_dt) = 8 then cast(try_strptime(sls_order_dt, '%Y%m%d') as date) end
  as sls_order_dt,
 case when length(sls_ship_dt) = 8 then cast(try_strptime(sls_ship_dt, '%Y%m%d') as date) end
  as sls_ship_dt,
 case when length(sls_due_dt) = 8 then cast(try_strptime(sls_due_dt, '%Y%m%d') as date) end
  as sls_due_dt,
 try_cast(nullif(sls_sales, '') as double) as sls_sales,
 try_cast(nullif(sls_quantity, '') as double) as sls_quantity,
 try_cast(nullif(sls_price, '') as double) as sls_price
from b_crm_sales_details
"""

ORACLES: dict[str, str] = {
    "bronze_counts": with_inputs(BRONZE_COUNTS),
    "bronze_line_breaks": f"""
select * replace (case when cst_key like '%3' then cst_lastname || chr(10) || '"' || cst_firstname || '"'
 when cst_key like '%7' then chr(10) || chr(10) || cst_lastname || ',' else cst_lastname end as cst_lastname)
from ({EXTRACTS["crm_cust_info"]})
""",
    "bronze_crm_cust": EXTRACTS["crm_cust_info"],
    "bronze_crm_prd": EXTRACTS["crm_prd_info"],
    "bronze_crm_sales": EXTRACTS["crm_sales_details"],
    "bronze_erp_cust": EXTRACTS["erp_cust_az12"],
    "bronze_erp_loc": EXTRACTS["erp_loc_a101"],
    "bronze_erp_cat": EXTRACTS["erp_px_cat_g1v2"],
    "profile_crm_cust": with_inputs(_PROFILES["crm_cust_info"]),
    "profile_crm_prd": with_inputs(_PROFILES["crm_prd_info"]),
    "profile_crm_sales": with_inputs(_PROFILES["crm_sales_details"]),
    "profile_erp_cust": with_inputs(_PROFILES["erp_cust_az12"]),
    "profile_erp_loc": with_inputs(_PROFILES["erp_loc_a101"]),
    "profile_erp_cat": with_inputs(_PROFILES["erp_px_cat_g1v2"]),
    "profile_report": with_inputs(PROFILE_REPORT),
    "silver_crm_cust": _select_all("s_crm_cust_info"),
    "silver_crm_prd": _select_all("s_crm_prd_info"),
    "silver_crm_sales": _select_all("s_crm_sales_details"),
    "silver_erp_cust": _select_all("s_erp_cust_az12"),
    "silver_erp_loc": _select_all("s_erp_loc_a101"),
    "silver_erp_cat": _select_all("s_erp_px_cat_g1v2"),
    "parsed_sales": with_inputs(PARSED_SALES),
    "split_product_keys": with_inputs(
        "select prd_id, replace(substr(prd_key, 1, 5), '-', '_') as cat_id, "
        "substr(prd_key, 7) as prd_key from b_crm_prd_info"
    ),
    "latest_customers": with_inputs(
        "select cst_id, max_by(cst_key, cst_create_date) as cst_key, "
        "max(cst_create_date) as cst_create_date from b_crm_cust_info where cst_id <> '' "
        "group by cst_id"
    ),
    "known_gender": with_inputs("select customer_id as cst_id, gender from g_dim_customers"),
    "dense_line_keys": with_inputs(ORDER_KEYS),
    "orphan_customer_rows": with_inputs(
        "select * from s_crm_sales_details where sls_cust_id not in "
        "(select cst_id from s_crm_cust_info)"
    ),
    "orphan_product_rows": with_inputs(
        "select * from s_crm_sales_details where sls_prd_key not in "
        "(select prd_key from s_crm_prd_info)"
    ),
    "live_dim_customers": _select_all("g_dim_customers"),
    "live_dim_products": _select_all("g_dim_products"),
    "live_fact_sales": _select_all("g_fact_sales"),
    "load_report": with_inputs(LOAD_REPORT),
    "silver_load_times": with_inputs(SILVER_LOAD_TIMES),
    "gold_dim_customers": _select_all("g_dim_customers"),
    "gold_dim_products": _select_all("g_dim_products"),
    "gold_fact_sales": _select_all("g_fact_sales"),
    "dq_unique_keys": with_inputs(UNIQUE_KEYS),
    "dq_coded_values": with_inputs(_DOMAINS),
    "dq_domains": with_inputs(UNAPPROVED),
    "dq_date_order": with_inputs(DATE_ORDER),
    "dq_sales_amount": with_inputs(SALES_AMOUNT),
    "dq_orphan_customers": with_inputs(ORPHAN_CUSTOMERS),
    "dq_orphan_products": with_inputs(ORPHAN_PRODUCTS),
    "dq_row_reconcile": with_inputs(RECONCILE),
    "dq_missing_keys": with_inputs(MISSING_KEYS),
    "dq_gold_amount": with_inputs(GOLD_AMOUNT),
    "hard_silver_sales": with_inputs("select * from s_crm_sales_details", HARD_EXTRACTS),
    "hard_silver_versions": with_inputs("select * from s_crm_prd_info", HARD_EXTRACTS),
    "hard_dim_customers": with_inputs(HARD_CUSTOMERS, HARD_EXTRACTS),
    "hard_gold_amount": with_inputs(
        GOLD_AMOUNT, {"crm_sales_details": HARD_EXTRACTS["crm_sales_details"]}
    ),
    "reloaded_tables": with_inputs(RELOADED),
    "dq_report": with_inputs(QUALITY_REPORT),
    "sales_by_country": with_inputs(SALES_BY_COUNTRY),
    "preview_dim_customers": with_inputs(
        "select * from g_dim_customers order by customer_key limit 10"
    ),
    "preview_fact_sales": with_inputs(
        "select * from g_fact_sales order by order_number, product_key nulls last, "
        "customer_key nulls last, order_date nulls last, ship_date, due_date, "
        "sales_amount nulls last, quantity, price nulls last limit 10"
    ),
}
