"""Small things several test modules need."""

import datetime
import decimal


def normal(value):
    if isinstance(value, datetime.datetime) and value.time() == datetime.time(0):
        return value.date().isoformat()
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return float(value)
    return value


def bag(columns, rows):
    """Column names in order, and the rows as a sorted list with columns in that order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(normal(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(body, key=repr)


def frame_bag(df):
    return bag(df.columns, df.collect())


def column(spark, values, expression, type_="string"):
    """The expression of column ``x`` for each value, in order."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {type_}")
    rows = df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()
    return [row["y"] for row in rows]
