"""Predicates with the null rules of the data-quality checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def differs(left: Column, right: Column) -> Column:
    """True when unequal *or* when either side is missing."""
    return F.coalesce(left != right, F.lit(True))


def holds(condition: Column) -> Column:
    """A comparison with a missing operand counts as not holding."""
    return F.coalesce(condition, F.lit(False))
