"""Tables bucketed and sorted by key in the warehouse: what joins or groups by that key needs no exchange."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Rows of a bucket, about, from which the number of buckets follows.
BUCKET_ROWS = 2_000_000


def save(rows: DataFrame, name: str, keys: Sequence[str], buckets: int | None = None, sort: Sequence[str] | None = None, path: str | None = None) -> int:
    """Write `rows` as the table `name`, at `path` or in the warehouse, in buckets of the keys' hash; returns their number.

    Rows are dealt to the buckets first, so a bucket is one sorted file. Tables to be joined need the same number, so give it for
    the second one. Rows that share a key share a bucket: a key of a third of all rows makes one large file, which a
    scan splits but a join of buckets does not; salt such a key, or leave the join to adaptive execution on plain tables.
    """
    buckets = buckets or max(1, -(-rows.count() // BUCKET_ROWS))
    writer = rows.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys)
    writer = writer.sortBy(*(sort or keys))
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return buckets


def exchanges(df: DataFrame) -> list[str]:
    """The shuffles of a plan before it runs, by kind."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)", plan)


def drop(spark: SparkSession, *names: str) -> None:
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
