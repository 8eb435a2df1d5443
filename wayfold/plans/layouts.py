"""Bucketed layouts and mergeable daily summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import summaries
from ..session import cut
from ..sources import bucketed, tables
from ..streaming.replay import folder
from .registry import query


@query("""
    SELECT o_orderkey AS id, o_orderstatus AS state, CAST(count(l_orderkey) AS BIGINT) AS parts, sum(l_quantity) AS quantity
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2
""")
def store_bucketed(spark, sf_dir):
    """Orders and their lines in buckets of the order's key: joined and grouped without a shuffle, which the query checks."""
    o, li = (tables.table(spark, sf_dir, n) for n in ("orders", "lineitem"))
    names = [f"{n}_{uuid.uuid4().hex}" for n in ("orders", "lines")]
    with folder(spark, "bucketed") as path:
        try:
            n = bucketed.save(li, names[1], ["l_orderkey"], max(4, spark.sparkContext.defaultParallelism), path=f"{path}/l")
            bucketed.save(o, names[0], ["o_orderkey"], n, path=f"{path}/o")
            left, right = spark.table(names[0]), spark.table(names[1])
            joined = left.join(right.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
            out = joined.groupBy("o_orderkey", "o_orderstatus").agg(F.count("l_orderkey").alias("parts"), F.sum("l_quantity").alias("quantity"))
            if shuffles := bucketed.exchanges(out):
                raise AssertionError(f"the buckets were shuffled: {shuffles}")
            return cut(out.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), "parts", "quantity"))
        finally:
            bucketed.drop(spark, *names)


def _events(spark, sf_dir):
    return tables.table(spark, sf_dir, "events").select("event_type", "user_id", "value", F.col("ts").cast("timestamp").alias("ts"))


def _judged(got, rows, keys):
    """The estimates beside what exact counting says: members within 3 %, and the median's rank within 2 % of a half."""
    rows = rows.join(got.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("q50").alias("_q")), on=[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    exact = rows.groupBy(*[f"_{k}" for k in keys]).agg(
        F.countDistinct("user_id").alias("_members"), F.count_if(F.col("value") < F.col("_q")).alias("_below"), F.count_if(F.col("value") <= F.col("_q")).alias("_upto"), F.count("value").alias("_n")
    )
    return got.join(exact, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).withColumns({
        "members_close": F.abs(F.col("members") - F.col("_members")) <= F.greatest(F.lit(1.0), 0.03 * F.col("_members")),
        "median_close": (F.col("_below") <= 0.52 * F.col("_n") + 1) & (F.col("_upto") >= 0.48 * F.col("_n") - 1),
    })


@query("""
    WITH d AS (SELECT DISTINCT event_type, CAST(ts AS DATE) AS day FROM events)
    SELECT d.event_type, CAST(d.day AS VARCHAR) AS day, count(*) AS n, min(e.value) AS least, max(e.value) AS most, true AS members_close, true AS median_close
    FROM d JOIN events e ON e.event_type = d.event_type AND CAST(e.ts AS DATE) BETWEEN d.day - 6 AND d.day GROUP BY ALL
""")
def summaries_rolling(spark, sf_dir):
    """Seven-day windows by type from daily sketches, held against exact counts of the same windows."""
    e = _events(spark, sf_dir)
    days = cut(summaries.daily(e, "ts", "user_id", "value", ["event_type"]))
    got = cut(summaries.estimates(summaries.rolling(days, 7, ["event_type"])))
    # the exact side sends each row to the seven windows that hold it
    rows = e.withColumn("day", F.explode(F.sequence(F.to_date("ts"), F.date_add(F.to_date("ts"), 6)))).select("event_type", "day", "user_id", "value")
    rows = rows.withColumnsRenamed({"event_type": "t", "day": "d"}).join(got.select("event_type", "day", "q50"), (F.col("t") == F.col("event_type")) & (F.col("d") == F.col("day"))).select("event_type", "day", "user_id", "value")
    return _judged(got, rows, ["event_type", "day"]).select("event_type", F.col("day").cast("string").alias("day"), "n", "least", "most", "members_close", "median_close")


@query("""
    SELECT event_type, CAST(day AS VARCHAR) AS day, count(*) AS n, min(value) AS least, max(value) AS most,
           grouping(event_type, day) AS level, true AS members_close
    FROM (SELECT *, CAST(ts AS DATE) AS day FROM events) GROUP BY GROUPING SETS ((event_type), (day), ())
""")
def summaries_sets(spark, sf_dir):
    """The same daily sketches merged by type, by day and over all, in one pass; distinct counts held against exact ones."""
    e = _events(spark, sf_dir)
    days = cut(summaries.daily(e, "ts", "user_id", "value", ["event_type"]))
    got = cut(summaries.estimates(summaries.over_sets(days, [["event_type"], ["day"], []])))
    plain = e.withColumn("day", F.to_date("ts"))
    exact = plain.groupingSets([[F.col("event_type")], [F.col("day")], []], F.col("event_type"), F.col("day")).agg(F.countDistinct("user_id").alias("_members"), F.grouping_id().alias("_level"))
    exact = exact.select(F.col("event_type").alias("_t"), F.col("day").alias("_d"), "_members", "_level")
    both = got.join(exact, F.col("event_type").eqNullSafe(F.col("_t")) & F.col("day").eqNullSafe(F.col("_d")) & (F.col("level") == F.col("_level")))
    close = F.abs(F.col("members") - F.col("_members")) <= F.greatest(F.lit(1.0), 0.03 * F.col("_members"))
    return both.select("event_type", F.col("day").cast("string").alias("day"), "n", "least", "most", "level", close.alias("members_close"))
