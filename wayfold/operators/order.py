"""Positions of rows in an order, for keys of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def numbered(rows: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str = "position", descending: bool = False) -> DataFrame:
    """`rows` with their position from 0 in the order of each key.

    `bucket` must not run against the order: a day for an order by time. Rows are numbered by bucket, each bucket
    from the count of those before it, so a key that holds a third of all rows spreads over its buckets. With `descending`
    the later buckets come first. Null buckets come last.
    """
    dealt = rows.withColumn("_bucket", bucket)
    sizes = dealt.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    turn = (F.desc_nulls_last if descending else F.asc_nulls_last)("_bucket")
    before = Window.partitionBy(*keys).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    nth = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return dealt.withColumn("_nth", nth).join(starts, same).withColumn(name, F.col("_start") + F.col("_nth") - 1).select(*rows.columns, name)


def preceding(rows: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], n: int, row: str, payload: Sequence[str]) -> DataFrame:
    """(row, rank, *payload): for each row's id its `n` nearest predecessors in the order of its key, the nearest with rank 1.

    Positions are numbered by bucket, and a row is sent to the `n` positions after it, so the join is by (key, position)
    and no key meets in one task.
    """
    placed = cut(numbered(rows.select(row, *payload, *[c for c in rows.columns if c != row and c not in payload]), keys, bucket, order, "_at"))
    sent = placed.select(
        *[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)], "_at", *[F.col(c).alias(f"_p{i}") for i, c in enumerate(payload)],
        F.explode(F.sequence(F.lit(1), F.lit(n))).alias("rank"),
    ).withColumn("_to", F.col("_at") + F.col("rank")).drop("_at")
    same = F.col("_at") == F.col("_to")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_s{i}"))
    return placed.select(row, *keys, "_at").join(sent, same).select(row, "rank", *[F.col(f"_p{i}").alias(c) for i, c in enumerate(payload)])
