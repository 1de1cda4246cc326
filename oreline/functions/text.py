"""String functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point the source rules treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Trim all Unicode white space from both ends; ``F.trim`` would remove spaces only."""
    return F.btrim(text, F.lit(WHITESPACE))


def first_chars(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def without_first(text: Column, n: int) -> Column:
    """Drop the first ``n`` characters; a shorter text gives an empty string."""
    return F.substr(text, F.lit(n + 1))


def swap(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def remove(text: Column, unwanted: str) -> Column:
    return F.replace(text, F.lit(unwanted), F.lit(""))


def drop_prefix(text: Column, prefix: str) -> Column:
    """Remove ``prefix`` once where the text starts with it."""
    return F.when(text.startswith(prefix), without_first(text, len(prefix))).otherwise(text)


def is_blank(text: Column) -> Column:
    return text.isNull() | (text == "")
