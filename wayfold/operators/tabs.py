"""Tab state in batch form: history, referrers, groups, orphans.

A tab's rows are ordered by (ts, event_id). One tab is one browser tab, so its rows
are bounded by a person's browsing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORPHAN_TTL_SECONDS = 60


def _tab():
    return Window.partitionBy("tab_id").orderBy("ts", "event_id")


def _so_far():
    return _tab().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def first_navigations(visits: DataFrame) -> DataFrame:
    """Visits of URLs that their tab has not shown before."""
    w = Window.partitionBy("tab_id", "url").orderBy("ts", "event_id")
    return visits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def history(visits: DataFrame) -> DataFrame:
    """Each tab's current URL, and the last different one with its time."""
    before, at = F.lag("url").over(_tab()), F.lag("page_loaded_at").over(_tab())
    moved = visits.withColumns({"_p": before, "_t": at}).withColumn("_moved", F.col("_p").isNotNull() & (F.col("_p") != F.col("url")))
    keep = lambda c: F.last(F.when(F.col("_moved"), F.col(c)), ignorenulls=True).over(_so_far())
    return moved.withColumns({"current_url": F.col("url"), "previous_url": keep("_p"), "previous_url_timestamp": keep("_t")}).drop("_p", "_t", "_moved")


def resolve_referrers(visits: DataFrame) -> DataFrame:
    """The tab's own previous URL, or the opener tab's current one where that is empty or blank.

    The opener's state at the time is a running last value over both tabs' rows, keyed
    by the opener, so no join multiplies rows.
    """
    own = visits.withColumn("_own", F.lag("url").over(_tab()))
    shown = own.select(F.col("tab_id").alias("_key"), "ts", "event_id", F.col("url").alias("_shown"), F.lit(False).alias("_ask"))
    asks = own.where(F.col("opener_tab_id").isNotNull()).select(
        F.col("opener_tab_id").alias("_key"), "ts", "event_id", F.lit(None).cast("string").alias("_shown"), F.lit(True).alias("_ask")
    )
    w = Window.partitionBy("_key").orderBy("ts", "event_id", F.desc("_ask")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opener = (
        shown.unionByName(asks).withColumn("_opener", F.last("_shown", ignorenulls=True).over(w))
        .where("_ask").select("event_id", "_opener")
    )
    blank = F.coalesce("_own", F.lit("")).isin("", "about:blank")
    return own.join(opener, "event_id", "left").withColumn(
        "referrer", F.when(blank, F.coalesce("_opener", F.lit(""))).otherwise(F.col("_own"))
    ).drop("_own", "_opener")


def inherit_groups(visits: DataFrame, opened: Column) -> DataFrame:
    """group_id: the last group that the tab opened or -1."""
    return visits.withColumn("_g", opened).withColumn("group_id", F.coalesce(F.last("_g", ignorenulls=True).over(_so_far()), F.lit(-1))).drop("_g")


def chain_statistics(visits: DataFrame) -> DataFrame:
    """Events, distinct URLs, duration and event kinds of each tab."""
    seconds = (F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 1e6
    return visits.groupBy("tab_id").agg(
        F.count("*").alias("events"), F.countDistinct("url").alias("urls"), F.round(seconds, 3).alias("duration_seconds"),
        F.count_if(F.col("event_type") == "view").alias("views"), F.bool_or(F.col("event_type") == "signup").alias("has_signup"),
    )


def navigation_statistics(navigations: DataFrame, chain: str = "tab_id", time: str = "ts") -> DataFrame:
    """Of each chain of parsed navigations: events, duration, distinct URLs, in-page ones and new tabs."""
    micros = F.unix_micros(time)
    return navigations.groupBy(chain).agg(
        F.count("*").alias("total_events"), F.floor((F.max(micros) - F.min(micros)) / 1000).alias("duration_ms"),
        F.countDistinct("url").alias("unique_urls"), F.count_if("is_spa").alias("spa_navigations"), F.count_if("is_new_tab").alias("new_tabs"),
    )


def _first_of_tab(arrivals: DataFrame) -> DataFrame:
    return arrivals.groupBy("tab_id").agg(F.min(F.struct("ts", "event_id")).alias("_first")).withColumnRenamed("tab_id", "opener_tab_id")


def orphans(arrivals: DataFrame) -> DataFrame:
    """Visits with an opener none of whose visits has arrived before."""
    asks = arrivals.where(F.col("opener_tab_id").isNotNull())
    late = F.col("_first").isNull() | (F.struct("ts", "event_id") <= F.col("_first"))
    return asks.join(_first_of_tab(arrivals), "opener_tab_id", "left").where(late).drop("_first")


def release(arrivals: DataFrame) -> DataFrame:
    """(id, parent_id): each orphan with the first visit of its opener that arrives after it."""
    first = arrivals.groupBy("tab_id").agg(F.min_by("id", F.struct("ts", "event_id")).alias("parent_id"), F.min(F.struct("ts", "event_id")).alias("_at"))
    o = orphans(arrivals)
    return o.join(first.withColumnRenamed("tab_id", "opener_tab_id"), "opener_tab_id").where(F.col("_at") > F.struct("ts", "event_id")).select("id", "parent_id")


def orphan_ages(orphans: DataFrame, now: Column) -> DataFrame:
    """Waiting and expired orphans of each opener, and the oldest's age."""
    age = F.unix_micros(now) - F.unix_micros("ts")
    return orphans.groupBy("opener_tab_id").agg(
        F.count("*").alias("waiting"), F.count_if(age > ORPHAN_TTL_SECONDS * 1_000_000).alias("expired"),
        F.round(F.max(age) / 1e6, 3).alias("oldest_seconds"),
    )
