"""The journal of a table's loads: which versions are being written, which are complete.

Every load writes a version, a folder of its own beside the older ones. ``_staged/<version>`` exists from before the first row is
written until the catalog points to the version; ``_committed/<version>`` exists once all its rows are written and
says how many. A load that was broken off leaves the first without the second (its rows are worth nothing), or both (its
rows are complete, and only the catalog has to follow).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

STAGED, COMMITTED = "_staged", "_committed"


@dataclass(frozen=True)
class Journal:
    """The loads of the table whose versions are under ``folder``."""

    spark: SparkSession
    folder: str

    def location(self, version: str) -> str:
        return f"{self.folder}/{version}"

    def begin(self) -> str:
        """Announce a load; the names of versions sort in the order of loads."""
        names = [*self._names(STAGED), *self._names(COMMITTED)]
        number = max((int(name[1:].split("-")[0]) for name in names), default=0) + 1
        version = f"v{number:010d}-{uuid.uuid4().hex}"
        self._write(f"{STAGED}/{version}", "")
        return version

    def commit(self, version: str, rows: int) -> None:
        self._write(f"{COMMITTED}/{version}", str(rows))

    def done(self, version: str) -> None:
        """The catalog points to the version."""
        self._delete(f"{STAGED}/{version}")

    def forget(self, version: str) -> None:
        """Remove a version: first what says that it is complete, then its rows."""
        for name in (f"{COMMITTED}/{version}", version, f"{STAGED}/{version}"):
            self._delete(name)

    def unfinished(self) -> list[str]:
        return self._names(STAGED)

    def complete(self) -> list[str]:
        """The complete versions, oldest first."""
        return self._names(COMMITTED)

    def rows(self, version: str) -> int:
        """How many rows the version was written with."""
        path = self._path(f"{COMMITTED}/{version}")
        stream = self._system(path).open(path)
        try:
            return int(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _system(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        path = self._path(name)
        system = self._system(path)
        if not system.exists(path):
            return []
        names = (status.getPath().getName() for status in system.listStatus(path))
        return sorted(n for n in names if n.startswith("v"))

    def _write(self, name: str, text: str) -> None:
        """Write a small file that exists as a whole or not at all."""
        path, part = self._path(name), self._path(f"{name.replace('/', '/_part-')}")
        system = self._system(path)
        stream = system.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not system.rename(part, path):
            raise OSError(f"cannot write {path}")

    def _delete(self, name: str) -> None:
        path = self._path(name)
        self._system(path).delete(path, True)
