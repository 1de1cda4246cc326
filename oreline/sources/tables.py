"""Layer tables: namespaces, scans, loads that put a new version in a table's place."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from oreline.schemas import LAYERS, LOAD_STAMP, SOURCE_TABLES
from oreline.session import remove_folder
from oreline.sources.journal import Journal


def stamped(df: DataFrame) -> DataFrame:
    """Add the load time as the last column; one value per load."""
    return df.withColumn(LOAD_STAMP, F.current_timestamp())


@dataclass(frozen=True)
class Warehouse:
    """The tables ``<prefix><layer>.<table>`` of a session.

    ``root`` puts the files under a folder of their own, so a later session can load over them or attach
    them; without it they are in the folders of the session's schemas. ``prefix`` keeps the layers apart from those of others in
    the same catalog. ``keep`` older versions of a table stay after a load, for frames that still read them.
    One driver loads a table at a time.
    """

    spark: SparkSession
    root: str | None = None
    file_format: str = "parquet"
    prefix: str = ""
    keep: int = 2

    def schema(self, layer: str) -> str:
        return f"{self.prefix}{layer}"

    def name(self, layer: str, table: str) -> str:
        return f"{self.schema(layer)}.{table}"

    def create_layers(self) -> None:
        """Create the layers, and bring tables whose load was broken off into order."""
        for layer in LAYERS:
            self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS {self.schema(layer)}")
        self.recover()

    def drop_layers(self) -> None:
        """Remove the layers with their tables and views, and the files."""
        for layer in reversed(LAYERS):
            schema = self.schema(layer)
            if self.spark.catalog.databaseExists(schema):
                home = self.spark.catalog.getDatabase(schema).locationUri
                self.spark.sql(f"DROP SCHEMA {schema} CASCADE")
                remove_folder(self.spark, home)
        if self.root is not None:
            remove_folder(self.spark, self.root)

    def list_layers(self) -> DataFrame:
        return self.spark.sql("SHOW SCHEMAS")

    def read(self, layer: str, table: str) -> DataFrame:
        return self.spark.table(self.name(layer, table))

    def load(self, df: DataFrame, layer: str, table: str) -> int:
        """Replace the table with ``df`` and return the rows written, counted during the write.

        The rows are written as a new version of the table, the journal says when they are complete, and then the catalog is
        pointed to them. A load that fails before leaves the table as it was; one that is broken off after that is
        completed by :meth:`recover`. Frames over the older version go on reading it until ``keep`` further loads are done.
        """
        journal = self.journal(layer, table)
        version = journal.begin()
        written = Observation(f"{layer}_{table}")
        writer = df.observe(written, F.count(F.lit(1)).alias("rows")).write.format(self.file_format)
        try:
            writer.save(journal.location(version))
        except Exception:
            journal.forget(version)
            raise
        rows = written.get["rows"]
        journal.commit(version, rows)
        self._point(layer, table, journal.location(version))
        journal.done(version)
        for old in journal.complete()[: -1 - self.keep]:
            journal.forget(old)
        return rows

    def recover(self) -> dict[str, str]:
        """Complete or roll back the loads that were broken off, and attach tables that the catalog does not know.

        A complete version that the catalog may not point to yet is put in place; an incomplete one is removed. Returns what was
        done, by table name: ``completed``, ``rolled back`` or ``attached``.
        """
        done = {}
        for layer in LAYERS:
            for table in self._stored(layer):
                name, journal = self.name(layer, table), self.journal(layer, table)
                unfinished, complete = journal.unfinished(), journal.complete()
                for version in set(unfinished) - set(complete):
                    journal.forget(version)
                    done[name] = "rolled back"
                if complete and set(unfinished) & set(complete):
                    self._point(layer, table, journal.location(complete[-1]))
                    done[name] = "completed"
                elif complete and not self.spark.catalog.tableExists(name):
                    self._point(layer, table, journal.location(complete[-1]))
                    done[name] = "attached"
                for version in set(unfinished) & set(complete):
                    journal.done(version)
        return done

    def loaded_rows(self, layer: str, table: str) -> int | None:
        """The rows that the table's last complete load wrote, as counted by it; null without one."""
        journal = self.journal(layer, table)
        complete = journal.complete()
        return journal.rows(complete[-1]) if complete else None

    def journal(self, layer: str, table: str) -> Journal:
        return Journal(self.spark, f"{self._home(layer)}/{table}")

    def _home(self, layer: str) -> str:
        """The folder of a layer's tables."""
        if layer not in LAYERS:
            raise ValueError(f"unknown layer: {layer}")
        if self.root is not None:
            return f"{self.root}/{layer}"
        return self.spark.catalog.getDatabase(self.schema(layer)).locationUri.rstrip("/")

    def _stored(self, layer: str) -> list[str]:
        """The tables that have files."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._home(layer))
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        return sorted(s.getPath().getName() for s in system.listStatus(path) if s.isDirectory())

    def _point(self, layer: str, table: str, folder: str) -> None:
        """Make the catalog's table read ``folder``; safe to be done again."""
        name = self.name(layer, table)
        given = self.spark.read.format(self.file_format).load(folder).schema
        known = self.spark.catalog.tableExists(name)
        if known and self.spark.catalog.getTable(name).tableType != "VIEW" and self.read(layer, table).schema == given:
            self.spark.sql(f"ALTER TABLE {name} SET LOCATION '{folder}'")
        else:
            # An external table: dropping it leaves its files.
            self.make_room(layer, table, for_view=False)
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.spark.catalog.createTable(name, path=folder, source=self.file_format)
        self.spark.catalog.refreshTable(name)

    def make_room(self, layer: str, table: str, for_view: bool) -> None:
        """Remove a table that a view is to replace, or a view that a table is to replace."""
        name = self.name(layer, table)
        if not self.spark.catalog.tableExists(name):
            return
        is_view = self.spark.catalog.getTable(name).tableType == "VIEW"
        if is_view and not for_view:
            self.spark.sql(f"DROP VIEW {name}")
        elif for_view and not is_view:
            self.drop(layer, table)

    def drop(self, layer: str, table: str) -> None:
        """Remove a table with all its versions."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name(layer, table)}")
        remove_folder(self.spark, self.journal(layer, table).folder)

    def preview(
        self, layer: str, table: str, order: str | Sequence[str], rows: int = 10
    ) -> DataFrame:
        """The first rows in the order of one or several columns: a top-k, not a sort of the table."""
        columns = [order] if isinstance(order, str) else order
        keys = [F.col(c).asc_nulls_last() for c in columns]
        return self.read(layer, table).orderBy(*keys).limit(rows)

    def bronze_tables(self) -> dict[str, DataFrame]:
        return {table: self.read("bronze", table) for table in SOURCE_TABLES}

    def silver_tables(self) -> dict[str, DataFrame]:
        return {table: self.read("silver", table) for table in SOURCE_TABLES}
