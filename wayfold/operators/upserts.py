"""Upserts as last-write-wins rewrites.

Parquet tables have no row-level MERGE, so a change set is merged by key in one shuffle and
the result is written as a new version. Change sets are reduced to a row a key first, and a null is a key like others.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_of_each(changes: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row of each key: the last by `order`; without one, or among rows equal in it, that of the largest hash."""
    rest = [c for c in changes.columns if c not in keys]
    if not rest:
        return changes.distinct()
    last = F.max_by(F.struct(*rest), F.struct(*order, F.xxhash64(*rest)))
    return changes.groupBy(*keys).agg(last.alias("_v")).select(*keys, *[f"_v.{c}" for c in rest])


def _renamed(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """`rows` with its keys under other names, and the condition that they equal the plain ones, null with null."""
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    return rows.withColumnsRenamed(names), functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """`table` with `changes` put over it by key; among changes of a key the last by `order` wins, so keys stay unique."""
    changes = last_of_each(changes, keys, order)
    new, same = _renamed(changes.select(*keys), keys)
    return table.join(new, same, "left_anti").unionByName(changes.select(*table.columns))


def new_keys(table: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Which changed keys the table does not have yet."""
    known, same = _renamed(table.select(*keys), keys)
    return changes.select(*keys).distinct().join(known, same, "left_anti")


def upsert_flagged(table: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(the table after the upsert; the changed keys with was_new: whether the table lacked them before)."""
    known, same = _renamed(table.select(*keys).distinct().withColumn("_was", F.lit(True)), keys)
    flags = changes.select(*keys).distinct().join(known, same, "left").select(*keys, F.col("_was").isNull().alias("was_new"))
    return upsert(table, changes, keys, order), flags


def upsert_trees(trees: DataFrame, changes: DataFrame) -> DataFrame:
    """Tree rows merged: the first load time never changes, the latest activity only moves forward."""
    old = trees.withColumn("_new", F.lit(0))
    return (
        old.unionByName(changes.withColumn("_new", F.lit(1))).groupBy("id")
        .agg(F.min_by("first_load_time", F.struct("_new", "first_load_time")).alias("first_load_time"), F.max("latest_activity_time").alias("latest_activity_time"))
    )


def delete_keys(table: DataFrame, keys: DataFrame) -> DataFrame:
    """The table without the rows of the keys, those with a null key among them if a key is null."""
    gone, same = _renamed(keys.distinct(), keys.columns)
    return table.join(gone, same, "left_anti")


def advance_trees(trees: DataFrame, changes: DataFrame) -> DataFrame:
    """Trees with (id, latest_activity_time) of `changes` where that is later; a tree that is not there is not made."""
    last = changes.groupBy("id").agg(F.max("latest_activity_time").alias("_last"))
    return trees.join(last, "id", "left").withColumn("latest_activity_time", F.greatest("latest_activity_time", "_last")).drop("_last")


def update_columns(table: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows whose keys are in `changes` with its other columns; unknown keys change nothing, a null is a value.

    Of repeated changes of a key the last by `order` counts, so no row is multiplied. `order` columns that the table lacks only order.
    """
    new = [c for c in changes.columns if c not in keys and c in table.columns]
    marked = last_of_each(changes, keys, order).select(*keys, F.struct(*new).alias("_v"))
    marked, same = _renamed(marked, keys)
    return table.join(marked, same, "left").select(
        *[F.when(F.col("_v").isNotNull(), F.col(f"_v.{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns]
    )
