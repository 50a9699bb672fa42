"""Versioned tables: a snapshot per run and a pointer to the current one.

A run writes ``snap=<n>`` whole and then replaces the pointer by a rename, so no
reader sees half a run.  One run writes at a time: it holds a lock file, which only
one can create.  Logs (reports, traces) are tables that every run appends to.  The pointer carries what every run must agree on (the
analyzer's version and the vectors' length).
"""

from __future__ import annotations

import json
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

META = {"analyzer": 2}


class Conflict(RuntimeError):
    """Two runs at the same time."""


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str, dimensions: int):
        self.spark, self.folder, self.meta = spark, folder.rstrip("/"), META | {"dimensions": dimensions}
        self.jvm = spark.sparkContext._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(self.folder)
        self.files = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def current(self) -> int | None:
        """Number of the current snapshot; an error where it was made in another way."""
        pointer = self._path("CURRENT")
        if not self.files.exists(pointer):
            return None
        held = json.loads("".join(r.value for r in self.spark.read.text(pointer.toString()).collect()))
        if {k: held.get(k) for k in self.meta} != self.meta:
            raise ValueError(f"the snapshot was made with {held}, not {self.meta}")
        return held["snapshot"]

    def read(self, table: str) -> DataFrame | None:
        number = self.current()
        path = self._path(f"snap={number}/{table}")
        return None if number is None or not self.files.exists(path) else self.spark.read.parquet(path.toString())

    @contextmanager
    def writing(self):
        """The lock of the one run that may write; an error while another holds it."""
        lock = self._path(".LOCK")
        try:
            self.files.create(lock, False).close()
        except Exception:
            raise Conflict(f"another run writes to {self.folder}") from None
        try:
            yield
        finally:
            self.files.delete(lock, False)

    def unlock(self) -> None:
        """Take away the lock of a run that died; only when no run is going on."""
        self.files.delete(self._path(".LOCK"), False)

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows to a log, which no snapshot replaces."""
        rows.write.mode("append").parquet(f"{self.folder}/{name}")

    def log(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def write(self, tables: dict[str, DataFrame]) -> int:
        """Write all tables as the next snapshot and make it the current one."""
        number = (self.current() or 0) + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/snap={number}/{name}")
        fresh, pointer = self._path(f".CURRENT.{number}"), self._path("CURRENT")
        out = self.files.create(fresh, True)
        out.write(bytearray(json.dumps(self.meta | {"snapshot": number}).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(self.files.makeQualified(fresh), self.files.makeQualified(pointer), options)
        return number
