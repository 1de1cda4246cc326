"""Final projection to a documented contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fitted(name: str, target: T.DataType) -> str:
    """SQL for column ``name`` in the contract's type; a value that doesn't fit stops the load.

    Amounts are rounded to the contract's scale. A fraction where the contract has whole numbers, and
    a value that the type cannot hold, raise an error, whatever the session's ANSI setting.
    """
    kind = target.simpleString()
    stop = f"raise_error(concat('{name} does not fit {kind}: ', CAST(`{name}` AS STRING)))"
    # The cast stands once: branches of a CASE would each make it anew, and that of amounts is dear.
    cast = f"coalesce(TRY_CAST(`{name}` AS {kind}), CASE WHEN `{name}` IS NOT NULL THEN {stop} END)"
    if isinstance(target, T.IntegralType):
        return f"CASE WHEN `{name}` <> floor(`{name}`) THEN {stop} ELSE {cast} END"
    return cast


def conform(df: DataFrame, contract: T.StructType) -> DataFrame:
    """Exactly the contract's columns, in its order and with its types; see :func:`fitted`."""
    given = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[
            F.col(f.name)
            if given[f.name] == f.dataType
            else F.expr(fitted(f.name, f.dataType)).alias(f.name)
            for f in contract.fields
        ]
    )
