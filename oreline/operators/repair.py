"""Price and amount repair of order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreline.functions.logic import differs, holds


def repair_sales(df: DataFrame, sales: str, quantity: str, price: str) -> DataFrame:
    """Back-fill the price, then the amount, in that order.

    1. A missing or non-positive price becomes amount / quantity (null for quantity 0), using the
       amount as delivered.
    2. The amount should be quantity x |price| with the price of step 1; a missing, negative or
       different amount becomes that, even where it is null.
    """
    has_price = holds(F.col(price) > 0)
    priced = df.withColumn(
        price,
        F.when(has_price, F.col(price)).otherwise(F.try_divide(F.col(sales), F.col(quantity))),
    )
    expected = F.col(quantity) * F.abs(F.col(price))
    broken = differs(F.col(sales), expected) | holds(F.col(sales) < 0)
    return priced.withColumn(sales, F.when(broken, expected).otherwise(F.col(sales)))
