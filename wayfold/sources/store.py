"""Tables that can be written: each write makes a new version, and readers see whole versions only.

A version is a folder of Parquet files with a name of its own, and a small file in the log that names the folder. The log file
is made last and only if there is none of its number, so of two writers that started from the same version one
fails with ConcurrentWrite and leaves the table as the other wrote it. A writer that dies leaves at most a folder that no log file names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.upserts import delete_keys, new_keys, update_columns, upsert
from ..session import remove


class ConcurrentWrite(RuntimeError):
    """Another writer has made the version that this one would have made."""


class VersionedTable:
    """A table at `path`, partitioned by `partitions` and sorted by `sort` inside each file."""

    def __init__(self, spark: SparkSession, path: str, partitions: Sequence[str] = (), sort: Sequence[str] = ()):
        self.spark, self.path, self.partitions, self.sort = spark, path, list(partitions), list(sort)
        self.jvm = spark.sparkContext._jvm
        self.fs = self._file("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _file(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _logged(self) -> list[int]:
        log = self._file("log")
        return sorted(int(f.getPath().getName()) for f in self.fs.listStatus(log)) if self.fs.exists(log) else []

    def _folder(self, number: int) -> str | None:
        """The folder that a log file names; None if its writer died before it had written the name."""
        stream = self.fs.open(self._file(f"log/{number:08d}"))
        try:
            return bytes(stream.readAllBytes()).decode() or None
        finally:
            stream.close()

    def _newest(self) -> tuple[int, str | None]:
        """(the last number in the log, the folder of the newest version)."""
        numbers = self._logged()
        for n in reversed(numbers):
            if folder := self._folder(n):
                return numbers[-1], folder
        return numbers[-1] if numbers else 0, None

    def _write(self, rows: DataFrame, base: int) -> None:
        if self.partitions:
            rows = rows.hint("rebalance", *self.partitions)  # a value that holds a third of all rows is split over tasks
        if self.sort:
            rows = rows.sortWithinPartitions(*self.partitions, *self.sort)
        folder = f"data-{uuid.uuid4().hex}"
        rows.write.partitionBy(*self.partitions).parquet(f"{self.path}/{folder}")
        try:
            stream = self.fs.create(self._file(f"log/{base + 1:08d}"), False)
        except Exception as e:
            remove(self.spark, f"{self.path}/{folder}")
            if base + 1 in self._logged():
                raise ConcurrentWrite(f"version {base + 1} of {self.path} is another writer's") from e
            raise
        stream.write(bytearray(folder.encode()))
        stream.close()

    def create(self, schema: str | T.StructType) -> None:
        """An empty table, unless there is one."""
        base, folder = self._newest()
        if folder is None:
            empty = self.spark.createDataFrame([], schema)
            # an empty partitioned table has no file that tells its columns
            self.spark.createDataFrame([(empty.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/schema")
            self._write(empty, base)

    def _read(self) -> tuple[int, DataFrame]:
        base, folder = self._newest()
        if folder is None:
            raise FileNotFoundError(self.path)
        schema = T.StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/schema").first()[0]))
        return base, self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")

    def read(self) -> DataFrame:
        return self._read()[1]

    def insert(self, rows: DataFrame) -> None:
        base, old = self._read()
        self._write(old.unionByName(rows.select(*old.columns)), base)

    def put(self, rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> None:
        """Insert or replace by key; of repeated keys the last by `order`."""
        base, old = self._read()
        self._write(upsert(old, rows, keys, order).select(*old.columns), base)

    def update(self, changes: DataFrame, keys: Sequence[str], order: Sequence[str] = (), known: bool = False) -> None:
        """Set the columns of `changes` where the key is there; with `known` a key that is not raises KeyError and nothing is written."""
        base, old = self._read()
        self._need(old, changes, keys, known)
        self._write(update_columns(old, changes, keys, order), base)

    def delete(self, keys: DataFrame, known: bool = False) -> None:
        base, old = self._read()
        self._need(old, keys, keys.columns, known)
        self._write(delete_keys(old, keys).select(*old.columns), base)

    @staticmethod
    def _need(old: DataFrame, changes: DataFrame, keys: Sequence[str], known: bool) -> None:
        missing = new_keys(old, changes, keys).limit(5).collect() if known else []
        if missing:
            raise KeyError(f"no row has {[tuple(r) for r in missing]}")
