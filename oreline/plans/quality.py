"""Checks of the loaded layers.

A rule gives one row (``rule``, ``violations``, ``checked``); the report adds where it applies and a
status. Only aggregates are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from oreline.functions.logic import differs, holds
from oreline.operators.counts import count_if, duplicates, key_counts, value_rows
from oreline.operators.lookup import orphan_count
from oreline.schemas import APPROVED_VALUES


class RowCountMismatch(AssertionError):
    """The fact table does not have one row per order line."""


def _rules(df: DataFrame, rules: dict[str, Column], *checked: Column) -> DataFrame:
    """Several counts over one pass of ``df`` as rule rows.

    ``checked`` counts what was looked at: once for all rules, or one for each.
    """
    seen = checked if len(checked) == len(rules) else checked * len(rules)
    counted = dict(zip(rules, seen, strict=True))

    def count(metric: Column) -> Column:
        return F.coalesce(metric, F.lit(0)).cast("long")

    one = df.agg(
        *[count(violations).alias(rule) for rule, violations in rules.items()],
        *[count(metric).alias(f"{rule}_checked") for rule, metric in counted.items()],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"),
                F.col(rule).alias("violations"),
                F.col(f"{rule}_checked").alias("checked"),
            )
            for rule in rules
        ]
    )
    return one.select(F.inline(rows))


def _all_rows() -> Column:
    return F.count(F.lit(1))


def unique_keys(customers: DataFrame, products: DataFrame) -> DataFrame:
    """Repeated customer ids and product keys.

    A product with several versions repeats its key by design, so that count is information; the
    rule that must hold is at most one current version per key.
    """
    current = F.sum(F.when(F.col("prd_end_dt").isNull(), 1).otherwise(0))
    versions = products.groupBy("prd_key").agg(
        F.count(F.lit(1)).alias("n"), current.alias("current")
    )
    extra_current = F.sum(F.greatest(F.col("current") - 1, F.lit(0)))
    return _rules(
        key_counts(customers, "cst_id"), {"duplicate_cst_id": duplicates()}, F.sum("n")
    ).unionByName(
        _rules(
            versions,
            {"duplicate_prd_key": duplicates(), "several_current_versions": extra_current},
            F.sum("n"),
        )
    )


def coded_values(silver: dict[str, DataFrame]) -> DataFrame:
    """Values found in the coded columns: (``table``, ``column``, ``value``, ``n``, ``approved``).

    ``approved`` is null for a column whose set is open.
    """
    by_table: dict[str, list[str]] = {}
    for table, column in APPROVED_VALUES:
        by_table.setdefault(table, []).append(column)
    parts = [
        value_rows(silver[table], columns).select(
            F.lit(table).alias("table"), F.col("metric").alias("column"), "value", "n"
        )
        for table, columns in by_table.items()
    ]
    verdict = F.lit(None).cast("boolean")
    for (table, column), approved in APPROVED_VALUES.items():
        if approved is not None:
            here = (F.col("table") == table) & (F.col("column") == column)
            verdict = F.when(here, holds(F.col("value").isin(*approved))).otherwise(verdict)
    return reduce(DataFrame.unionByName, parts).withColumn("approved", verdict)


def unapproved_values(silver: dict[str, DataFrame]) -> DataFrame:
    """Rows with a value outside its approved set."""
    values = coded_values(silver).filter(F.col("approved").isNotNull())
    bad = F.sum(F.when(~F.col("approved"), F.col("n")))
    return _rules(values, {"unapproved_value": bad}, F.sum("n"))


def _date_order() -> Column:
    ordered, due, shipped = (F.col(f"sls_{c}_dt") for c in ("order", "due", "ship"))
    return holds(ordered > due) | holds(ordered > shipped)


def _amount_mismatch() -> Column:
    return differs(F.col("sls_sales"), F.col("sls_quantity") * F.col("sls_price"))


def _bad_amount() -> Column:
    return (
        _amount_mismatch() | holds(F.col("sls_quantity") <= 0) | holds(F.col("sls_price") <= 0)
    )


def date_order(sales: DataFrame) -> DataFrame:
    return _rules(sales, {"order_after_ship_or_due": count_if(_date_order())}, _all_rows())


def sales_amount(sales: DataFrame) -> DataFrame:
    """Amount = quantity x price, and the same with both factors positive."""
    return _rules(
        sales,
        {
            "amount_mismatch": count_if(_amount_mismatch()),
            "bad_amount_or_factor": count_if(_bad_amount()),
        },
        _all_rows(),
    )


def orphan_customers(sales: DataFrame, customers: DataFrame) -> DataFrame:
    return orphan_count(sales, "sls_cust_id", customers, "cst_id").select(
        F.lit("orphan_customer").alias("rule"), "violations", "checked"
    )


def orphan_products(sales: DataFrame, products: DataFrame) -> DataFrame:
    return orphan_count(sales, "sls_prd_key", products, "prd_key").select(
        F.lit("orphan_product").alias("rule"), "violations", "checked"
    )


def _missing_key() -> Column:
    return F.col("customer_key").isNull() | F.col("product_key").isNull()


def _gold_amount_mismatch() -> Column:
    return differs(F.col("sales_amount"), F.col("quantity") * F.col("price"))


def gold_amount(fact: DataFrame) -> DataFrame:
    """Fact rows whose amount is not quantity x price as Gold has them: rounding to the contract's scale can part
    what agrees in Silver."""
    return _rules(fact, {"gold_amount_mismatch": count_if(_gold_amount_mismatch())}, _all_rows())


def _lines_and_facts(sales: DataFrame, fact: DataFrame) -> DataFrame:
    """Both tables in one, a row each; ``line`` and ``fact`` are 1 or 0."""
    lines = sales.select(F.lit(1).alias("line"), F.lit(0).alias("fact"))
    return lines.unionByName(fact.select(F.lit(0).alias("line"), F.lit(1).alias("fact")))


def _row_difference() -> Column:
    return F.abs(F.sum("line") - F.sum("fact"))


def row_reconcile(sales: DataFrame, fact: DataFrame) -> DataFrame:
    """Order lines against fact rows; ``violations`` is the difference."""
    sides = _lines_and_facts(sales, fact)
    return _rules(sides, {"fact_rows_differ": _row_difference()}, F.sum("line"))


def require_row_per_line(sales: DataFrame, fact: DataFrame) -> None:
    """Raise unless the fact table has as many rows as there are order lines."""
    lines, rows = sales.count(), fact.count()
    if lines != rows:
        raise RowCountMismatch(f"{lines} order lines but {rows} fact rows")


def require_no_difference(report: list[Row]) -> None:
    """Raise if the rows of a quality report say that fact rows and order lines differ in number."""
    for row in report:
        if row["rule"] == "fact_rows_differ" and row["violations"]:
            raise RowCountMismatch(
                f"{row['checked']} order lines, and {row['violations']} fact rows more or fewer"
            )


def missing_keys(fact: DataFrame) -> DataFrame:
    return _rules(fact, {"missing_surrogate_key": count_if(_missing_key())}, _all_rows())


def load_counts(sources: dict[str, DataFrame | int], loaded: dict[str, DataFrame]) -> DataFrame:
    """Rows per table at the source and after the load: (``table``, ``source_rows``,
    ``loaded_rows``, ``difference``). A source is a table to be counted, or the rows counted when it was read."""

    spark = next(iter(loaded.values())).sparkSession

    def counted(tables: dict[str, DataFrame | int], side: str) -> DataFrame:
        parts = [
            (df.agg(F.count(F.lit(1)).alias(side)) if isinstance(df, DataFrame)
             else spark.range(1).select(F.lit(df).cast("long").alias(side)))
            .select(F.lit(name).alias("table"), side)
            for name, df in tables.items()
        ]
        return reduce(DataFrame.unionByName, parts)

    both = counted(sources, "source_rows").join(counted(loaded, "loaded_rows"), "table", "full")
    rows = both.select(
        "table",
        F.coalesce("source_rows", F.lit(0)).cast("long").alias("source_rows"),
        F.coalesce("loaded_rows", F.lit(0)).cast("long").alias("loaded_rows"),
    )
    return rows.withColumn("difference", F.col("loaded_rows") - F.col("source_rows"))


# Where each rule looks.
RULE_PLACES = {
    "duplicate_cst_id": ("silver", "crm_cust_info"),
    "duplicate_prd_key": ("silver", "crm_prd_info"),
    "several_current_versions": ("silver", "crm_prd_info"),
    "unapproved_value": ("silver", "all coded columns"),
    "order_after_ship_or_due": ("silver", "crm_sales_details"),
    "amount_mismatch": ("silver", "crm_sales_details"),
    "bad_amount_or_factor": ("silver", "crm_sales_details"),
    "orphan_customer": ("silver", "crm_sales_details"),
    "orphan_product": ("silver", "crm_sales_details"),
    "fact_rows_differ": ("gold", "fact_sales"),
    "missing_surrogate_key": ("gold", "fact_sales"),
    "gold_amount_mismatch": ("gold", "fact_sales"),
}
# Rules that describe the data instead of failing it.
INFORMATION = ("duplicate_prd_key",)


def _key_sums(sales: DataFrame, customers: DataFrame, products: DataFrame, fact: DataFrame) -> list[Row]:
    """For customers, products and facts (``kind``): rows, and rows whose key is unknown.

    An order line is two entries, one under its customer and one under its product; known customers and products are entries
    that count no line. Grouped by key, a task ships one short row for each key.
    """

    def entry(kind: str, key: Column, known: bool, n: int) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), key.cast("string").alias("k"), F.lit(known).alias("known"),
            F.lit(n).cast("long").alias("n"),
        )

    def entries(df: DataFrame, *cells: Column) -> DataFrame:
        return df.select(F.inline(F.array(*cells)))

    lines = (entry("customer", F.col("sls_cust_id"), False, 1), entry("product", F.col("sls_prd_key"), False, 1))
    parts = [
        entries(sales, *lines),
        entries(customers, entry("customer", F.col("cst_id"), True, 0)),
        entries(products, entry("product", F.col("prd_key"), True, 0)),
        entries(fact, entry("fact", F.lit(None), True, 1)),
    ]
    by_key = (
        reduce(DataFrame.unionByName, parts)
        .groupBy("kind", "k")
        .agg(F.bool_or("known").alias("known"), F.sum("n").alias("n"))
    )
    sums = by_key.groupBy("kind").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(~F.col("known"), F.col("n"))), F.lit(0)).alias("unknown")
    )
    return sums.collect()  # three rows


_LINE_RULES = {
    "order_after_ship_or_due": _date_order,
    "amount_mismatch": _amount_mismatch,
    "bad_amount_or_factor": _bad_amount,
}
_FACT_RULES = {"missing_surrogate_key": _missing_key, "gold_amount_mismatch": _gold_amount_mismatch}


def _order_rules(silver: dict[str, DataFrame], fact: DataFrame) -> DataFrame:
    """All rules on order lines and fact rows, from one scan of each; runs when called.

    What is judged row by row is counted by observing the scans that feed the key aggregate, so only keys are
    shuffled. A task that runs again after an executor was lost may be observed twice; the key aggregate's row counts
    are exact and tell, and then these rules are counted on their own.
    """
    sales, rows = silver["crm_sales_details"], {}
    judged = {"line": (sales, _LINE_RULES, "customer"), "fact": (fact, _FACT_RULES, "fact")}

    def counts(rules: dict[str, Callable[[], Column]]) -> list[Column]:
        return [_all_rows().alias("rows"), *[count_if(rule()).alias(name) for name, rule in rules.items()]]

    seen = {side: Observation() for side in judged}
    watched = {side: df.observe(seen[side], *counts(rules)) for side, (df, rules, _) in judged.items()}
    sums = {
        row["kind"]: row
        for row in _key_sums(watched["line"], silver["crm_cust_info"], silver["crm_prd_info"], watched["fact"])
    }
    exact = {kind: sums[kind]["rows"] if kind in sums else 0 for kind in ("customer", "product", "fact")}
    for side, (df, rules, kind) in judged.items():
        found = seen[side].get if exact[kind] else {}  # nothing is observed where no row is
        if found.get("rows", 0) != exact[kind]:
            found = df.agg(*counts(rules)).first().asDict()
        rows.update({name: (found.get(name) or 0, exact[kind]) for name in rules})
    for name, kind in (("orphan_customer", "customer"), ("orphan_product", "product")):
        rows[name] = (sums[kind]["unknown"] if kind in sums else 0, exact[kind])
    rows["fact_rows_differ"] = (abs(exact["customer"] - exact["fact"]), exact["customer"])
    spark = sales.sparkSession
    return spark.createDataFrame([(name, *n) for name, n in rows.items()], "rule string, violations long, checked long")


def quality_report(silver: dict[str, DataFrame], fact: DataFrame) -> DataFrame:
    """All Silver and Gold rules: (``layer``, ``table``, ``rule``, ``violations``, ``checked``,
    ``status``). The order lines and the fact rows are read once for all rules on them, when this is called."""
    loads = _order_rules(silver, fact)
    sections = [
        unique_keys(silver["crm_cust_info"], silver["crm_prd_info"]),
        unapproved_values(silver),
        loads,
    ]
    places = F.create_map(
        *[F.lit(x) for rule, (layer, table) in RULE_PLACES.items() for x in (rule, f"{layer}.{table}")]
    )
    place = F.split(places[F.col("rule")], "\\.")
    status = (
        F.when(F.col("rule").isin(*INFORMATION), "info")
        .when(F.col("violations") == 0, "ok")
        .otherwise("failed")
    )
    return reduce(DataFrame.unionByName, sections).select(
        place[0].alias("layer"),
        place[1].alias("table"),
        "rule",
        "violations",
        "checked",
        status.alias("status"),
    )
