"""Analytic queries on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sales_by_country(fact: DataFrame, customers: DataFrame) -> DataFrame:
    """Total sales per known country, largest first.

    The fact is summed per customer key before the join. That shuffles one partial sum per key and
    task, however many lines one customer (or the missing key) holds. Customer keys are unique.
    """
    per_customer = fact.groupBy("customer_key").agg(F.sum("sales_amount").alias("amount"))
    countries = customers.filter(F.col("country").isNotNull()).select("customer_key", "country")
    return (
        per_customer.join(countries, "customer_key")
        .groupBy("country")
        .agg(F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(38,2)").alias("sales_amount"))
        .orderBy(F.desc_nulls_last("sales_amount"), "country")
    )
