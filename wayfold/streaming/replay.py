"""A table played back as a stream of micro-batches in the order of a column."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, remove, shared_dir

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a file of a slice, about.
FILE_ROWS = 1_000_000


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that stateful operators with map and list state need, for as long as it is needed."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(key, old) if old else spark.conf.unset(key)


@contextmanager
def folder(spark: SparkSession, what: str) -> Iterator[str]:
    """A path in the shared folder, gone at the end."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        remove(spark, path)


def write_slices(rows: DataFrame, path: str, order: str, slices: int) -> int:
    """Write `rows` as `slices` runs of the time column `order`, one after the other; returns the files of a slice.

    Bounds are approximate quantiles, so a sketch is all that reaches the driver. The file source takes files by the time they
    were written, and every slice has the same number, so a micro-batch of that many files is a slice.
    """
    rows = cut(rows)
    at = F.unix_micros(order).cast("double")
    n, bounds = rows.agg(F.count("*"), F.percentile_approx(at, [i / slices for i in range(1, slices)], 10_000)).first()
    files = max(1, -(-n // (slices * FILE_ROWS)))
    edges = [float("-inf"), *(bounds or []), float("inf")]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        rows.where((at > a) & (at <= b)).repartition(files).write.mode("append").parquet(path)
    return files


def replayed(rows: DataFrame, path: str, order: str, slices: int = 6) -> DataFrame:
    """`rows` as a stream of `slices` micro-batches or so, in the order of a time column."""
    files = write_slices(rows, path, order, slices)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def run_through(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over all that is there and return what it wrote under `path`."""
    from .ingest import start

    start(stream, f"{path}/out", f"{path}/log").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
