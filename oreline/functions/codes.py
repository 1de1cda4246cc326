"""Code to label mappings and other conditional columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from oreline.functions.text import strip
from oreline.schemas import UNKNOWN

# Code to label, compared after trimming and upper-casing.
MARITAL_STATUS = {"S": "Single", "M": "Married"}
CRM_GENDER = {"M": "Male", "F": "Female"}
ERP_GENDER = {"M": "Male", "MALE": "Male", "F": "Female", "FEMALE": "Female"}
PRODUCT_LINE = {"R": "Road", "M": "Mountain", "S": "Other Sales", "T": "Touring"}
COUNTRY = {"US": "United States", "USA": "United States", "DE": "Germany", "": UNKNOWN}


def label(code: Column, labels: Mapping[str, str], default: str | Column = UNKNOWN) -> Column:
    """Label of a padded, mixed-case code; anything unrecognised or missing gives ``default``.

    A map literal, not a ``when`` chain, so the cleaned code is computed once per row.
    """
    known = F.create_map(*[F.lit(item) for pair in labels.items() for item in pair])
    otherwise = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(known[F.upper(strip(code))], otherwise)


def country_name(raw: Column) -> Column:
    """Canonical country; an unlisted country keeps its own spelling, trimmed."""
    return label(raw, COUNTRY, default=F.coalesce(strip(raw), F.lit(UNKNOWN)))


def prefer_known(first: Column, second: Column) -> Column:
    """``first`` unless it is unknown, else ``second``, else unknown."""
    return F.when(first != UNKNOWN, first).otherwise(F.coalesce(second, F.lit(UNKNOWN)))


def past_or_null(day: Column, as_of: Column) -> Column:
    """Null out days after ``as_of``."""
    return F.when(day <= as_of, day)
