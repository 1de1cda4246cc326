"""What several operators need: shared tables, the training split, sizes, two-level ranks."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oreline.session import remove_folder, run_folder

FOLDS, HELD_OUT_FOLD = 4, 2

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; null ids never train."""
    fold = F.crc32(doc_id.cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT_FOLD, F.lit(True))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="oreline-package-"), "oreline_package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


class Scratch:
    """Tables written next to the checkpoints, so that no lost executor makes a step run again.

    The folder goes when the driver's Python ends; ``drop`` removes a table sooner.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = run_folder(spark, name)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, **options: int) -> DataFrame:
        df.write.mode("overwrite").options(**options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            remove_folder(self.spark, self.path(name))


def word_count(text: Column) -> Column:
    """Number of words, runs of anything but blanks and the controls from tab to carriage return; null
    has none."""
    spaced = F.trim(F.translate(text, "\t\n\x0b\f\r", "     "))
    parts = F.size(F.split(spaced, " +"))
    return F.when(text.isNull() | (spaced == ""), F.lit(0)).otherwise(parts).cast("long")


def drawn(*key: Column | str) -> Column:
    """A number from 0 to 2**63 drawn by hash; rows in its order are a sample."""
    return F.shiftrightunsigned(F.xxhash64(*key), 1)


def among_first(wanted: int, total: int) -> int:
    """A bound that the first ``wanted`` of ``total`` drawn numbers keep, and twice as many in all.

    It keeps the rows that a sample is sorted out of as few as the sample, however many tasks there are.
    """
    return 2**63 - 1 if total <= 2 * wanted else int(2 * wanted / total * 2**63)


def prefix_sums(df: DataFrame, group: list[str], order: list[str], amount: str, out: str) -> DataFrame:
    """Sum of ``amount`` over the earlier rows of the group."""
    window = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(amount).over(window), F.lit(0)))
