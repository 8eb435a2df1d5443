import pytest
from pyspark.sql import functions as F

from wayfold.operators import upserts
from wayfold.sources.store import ConcurrentWrite, VersionedTable

ROW = "key long, value string"


def table(spark, path, **more):
    t = VersionedTable(spark, str(path), **more)
    t.create(ROW)
    return t


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROW)


def read(t):
    return sorted(map(tuple, t.read().collect()), key=str)


def test_repeated_and_null_keys_stay_unique(spark, tmp_path):
    t = table(spark, tmp_path)
    t.put(rows(spark, (1, "b"), (1, "c"), (None, "m"), (None, "n")), ["key"], ["value"])
    assert read(t) == [(1, "c"), (None, "n")]
    t.put(rows(spark, (None, "o"), (2, "x")), ["key"])
    assert read(t) == [(1, "c"), (2, "x"), (None, "o")]
    t.update(rows(spark, (1, "d"), (1, "e"), (None, "p"), (9, "q")), ["key"], ["value"])
    assert read(t) == [(1, "e"), (2, "x"), (None, "p")]
    t.delete(rows(spark, (None, None), (1, None), (1, None)).select("key"))
    assert read(t) == [(2, "x")]


def test_unknown_keys_are_errors_where_asked(spark, tmp_path):
    t = table(spark, tmp_path)
    t.insert(rows(spark, (1, "a")))
    for change in (lambda: t.update(rows(spark, (2, "b")), ["key"], known=True), lambda: t.delete(rows(spark, (2, None)).select("key"), known=True)):
        with pytest.raises(KeyError, match="2"):
            change()
    assert read(t) == [(1, "a")]


def test_a_dead_writer_leaves_a_table_that_can_be_written(spark, tmp_path):
    t = table(spark, tmp_path)
    t.insert(rows(spark, (1, "a")))
    rows(spark, (7, "half")).write.parquet(str(tmp_path / "data-dead"))  # died before its log file
    (tmp_path / "log" / "00000003").write_text("")  # died while it wrote the log file
    assert read(t) == [(1, "a")]
    t.insert(rows(spark, (2, "b")))
    assert read(t) == [(1, "a"), (2, "b")]
    assert read(VersionedTable(spark, str(tmp_path))) == [(1, "a"), (2, "b")]


def test_of_two_writers_one_fails_cleanly(spark, tmp_path):
    t = table(spark, tmp_path)
    base, old = t._read()
    t.insert(rows(spark, (1, "first")))
    with pytest.raises(ConcurrentWrite):
        t._write(old.unionByName(rows(spark, (2, "second"))), base)
    assert read(t) == [(1, "first")]
    assert len(list(tmp_path.glob("data-*"))) == 2  # the loser's folder is gone
    t.insert(rows(spark, (2, "second")))
    assert read(t) == [(1, "first"), (2, "second")]


def test_a_hot_partition_value_is_split(spark, tmp_path):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes",)}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        t = table(spark, tmp_path, partitions=["value"], sort=["key"])
        t.insert(spark.range(60_000).select(F.col("id").alias("key"), F.when(F.col("id") % 3 == 0, F.lit("rare")).otherwise("hot").alias("value")))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    newest = t._newest()[1]
    assert len(list((tmp_path / newest / "value=hot").glob("*.parquet"))) > 1
    assert t.read().count() == 60_000


def test_was_new_flags(spark):
    after, flags = upserts.upsert_flagged(rows(spark, (1, "a"), (None, "n")), rows(spark, (1, "b"), (2, "c"), (2, "d"), (None, "m")), ["key"], ["value"])
    assert sorted(map(tuple, after.collect()), key=str) == [(1, "b"), (2, "d"), (None, "m")]
    assert {r.key: r.was_new for r in flags.collect()} == {1: False, 2: True, None: False}
