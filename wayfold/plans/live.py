"""Streaming queries over the event table, played back in several micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import table, visits
from ..streaming import ingest, orphans, trees
from ..streaming.replay import folder, replayed, rocksdb, run_through
from .browsing import VISITS
from .registry import query

SLICES = 6
HOUR = 3_600_000
#: Orphans wait up to 4 of 5 hourly retries; a parent is remembered for a day.
KNOBS = {"ttl_ms": 4 * HOUR, "retry_ms": HOUR, "max_retries": 5, "parent_ttl_ms": 24 * HOUR}

PLACED = f"""
    {VISITS}, placed AS (
        SELECT v.id, v.tab_id, v.ts, p.parent_id FROM visits v LEFT JOIN (
            SELECT a.id, arg_max(b.id, (b.ts, b.id)) AS parent_id
            FROM visits a JOIN visits b ON a.tab_id = b.tab_id AND starts_with(b.url, a.referrer) AND (b.ts, b.id) < (a.ts, a.id)
            WHERE a.referrer IS NOT NULL GROUP BY a.id
        ) p ON v.id = p.id
    ), climb(id, tree_id) AS (
        SELECT id, id FROM placed WHERE parent_id IS NULL
        UNION ALL
        SELECT p.id, c.tree_id FROM placed p JOIN climb c ON p.parent_id = c.id
    )
"""


def _placed(spark, sf_dir, path):
    v = visits(spark, sf_dir).select("id", "tab_id", "ts", "url", "referrer")
    with rocksdb(spark):
        return run_through(trees.insert_into_trees(replayed(v, f"{path}/in", "ts", SLICES)), path)


@query(f"WITH RECURSIVE {PLACED} SELECT p.id, p.parent_id, c.tree_id FROM placed p JOIN climb c ON p.id = c.id")
def stream_tree_insert(spark, sf_dir):
    """Trees of each tab, kept while its visits arrive."""
    with folder(spark, "trees") as path:
        return cut(_placed(spark, sf_dir, path).select("id", "parent_id", "tree_id"))


@query(f"""
    WITH RECURSIVE {PLACED}, trees AS (
        SELECT tab_id, tree_id, min(ts) AS first_at, max(ts) AS latest_at, count(*) AS members
        FROM placed p JOIN climb c ON p.id = c.id GROUP BY ALL
    ), top AS (
        SELECT * FROM trees ORDER BY latest_at DESC, tree_id LIMIT 5 OFFSET 1
    )
    SELECT t.tree_id, epoch_us(t.first_at) AS first_at, epoch_us(t.latest_at) AS latest_at, t.members, p.id
    FROM top t JOIN climb c ON c.tree_id = t.tree_id JOIN placed p ON p.id = c.id AND p.tab_id = t.tab_id
""")
def kept_recent_trees(spark, sf_dir):
    """The most recently active trees read off kept trees; no visit is climbed again."""
    with folder(spark, "trees") as path:
        placed = cut(_placed(spark, sf_dir, path))
    m = trees.recent_members(placed, 5, 1).select("owner", "tree_id", "id")
    return trees.kept_trees(placed).join(m, ["owner", "tree_id"]).select("tree_id", "first_at", "latest_at", "members", "id")


def _arrivals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").alias("tab_id"),
        F.when(F.col("event_type").isin("click", "view"), F.col("user_id") + 1).alias("opener_tab_id"), F.col("ts").cast("timestamp").alias("ts"),
    )


ARRIVALS = """
    arrivals AS (
        SELECT CAST(event_id AS VARCHAR) AS id, user_id AS tab_id, CASE WHEN event_type IN ('click', 'view') THEN user_id + 1 END AS opener_tab_id,
               ts, epoch_ms(ts) AS ms
        FROM events
    )
"""
TIMELINE = f"""
    {ARRIVALS}, ends AS (
        SELECT max(ms) - 60000 AS stop FROM arrivals
    ), met AS (
        SELECT c.id, c.opener_tab_id AS tab, c.ms,
               arg_max(p.id, (p.ms, p.id)) FILTER (p.ms <= c.ms AND c.ms - p.ms <= {KNOBS["parent_ttl_ms"]}) AS earlier,
               arg_min(p.id, (p.ms, p.id)) FILTER (p.ms > c.ms AND p.ms - c.ms <= {4 * HOUR}) AS later,
               min(p.ms - c.ms) FILTER (p.ms > c.ms) AS gap
        FROM arrivals c LEFT JOIN arrivals p ON p.tab_id = c.opener_tab_id WHERE c.opener_tab_id IS NOT NULL GROUP BY ALL
    ), lived AS (
        SELECT id, tab, ms, coalesce(earlier, later) AS parent_id,
               CASE WHEN coalesce(earlier, later) IS NOT NULL THEN 'attached' WHEN ms + {4 * HOUR} < stop THEN 'expired' ELSE 'waiting' END AS state,
               CASE WHEN earlier IS NOT NULL THEN 0 WHEN later IS NOT NULL THEN gap // {HOUR} WHEN ms + {4 * HOUR} < stop THEN 4 END AS retries
        FROM met, ends
    )
"""


def _lived(spark, sf_dir):
    """Every child with what became of it, and the moment the replay ended at."""
    v = _arrivals(spark, sf_dir)
    with folder(spark, "orphans") as path, rocksdb(spark):
        done = cut(run_through(orphans.orphan_timeline(replayed(v, f"{path}/in", "ts", SLICES), "1 minute", **KNOBS), path))
    children = v.where("opener_tab_id IS NOT NULL").select("id", F.col("opener_tab_id").alias("tab"), orphans.millis(F.col("ts")).alias("at"))
    lived = children.join(done.select("id", "parent_id", "state", "retries"), "id", "left").withColumn("state", F.coalesce("state", F.lit("waiting")))
    return lived, v.agg(F.max(orphans.millis(F.col("ts"))).alias("now")).select(F.col("now") - 60_000)


@query(f"WITH {TIMELINE} SELECT id, tab, parent_id, state, CAST(retries AS INTEGER) AS retries FROM lived")
def stream_orphan_timeline(spark, sf_dir):
    """Each child: attached with the retries that it took, expired, or waiting at the end."""
    lived, _ = _lived(spark, sf_dir)
    return lived.select("id", "tab", "parent_id", "state", "retries")


@query(f"""
    WITH {TIMELINE} SELECT tab, count(*) AS orphans, max(stop - ms) AS oldest_age_ms FROM lived, ends
    WHERE state = 'waiting' AND stop - ms <= {2 * HOUR} GROUP BY tab
""")
def stream_orphan_stats(spark, sf_dir):
    """What waits at the end, by tab, once those of more than two hours are evicted."""
    lived, now = _lived(spark, sf_dir)
    # the moment is one row
    waiting = lived.where("state = 'waiting'").join(F.broadcast(now.toDF("now")))
    return orphans.waiting_stats(waiting, F.col("now"), 2 * HOUR)


def _with_end(v):
    """The rows and one far later that meets no other: it moves the watermark past all of them."""
    end = v.agg(F.max("ts").alias("ts")).select(
        F.lit("end").alias("id"), F.lit(-1).cast("long").alias("tab_id"), F.lit(-2).cast("long").alias("opener_tab_id"),
        (F.coalesce("ts", F.lit("2024-01-01").cast("timestamp")) + F.expr("INTERVAL 30 DAYS")).alias("ts"),
    )
    return v.unionByName(end)


@query(f"""
    WITH {ARRIVALS}
    SELECT c.id AS child_id, o.id AS opener_id FROM arrivals c
    LEFT JOIN arrivals o ON o.tab_id = c.opener_tab_id AND o.ts <= c.ts AND o.ts >= c.ts - INTERVAL 6 HOURS WHERE c.opener_tab_id IS NOT NULL
""")
def stream_opener_join(spark, sf_dir):
    """Children with all visits of their opener tab in the six hours before, or none, joined as streams."""
    v = _with_end(_arrivals(spark, sf_dir))
    with folder(spark, "openers") as path, rocksdb(spark):
        stream = replayed(v, f"{path}/in", "ts", SLICES)
        got = run_through(ingest.opener_join(stream.where("opener_tab_id IS NOT NULL"), stream, "6 HOURS"), path)
        return cut(got.where("child_id <> 'end'").select("child_id", "opener_id"))


@query("""
    SELECT event_type, epoch_us(w) AS starts, count(*) AS n FROM (
        SELECT event_type, unnest([time_bucket(INTERVAL 2 HOURS, ts) - INTERVAL 2 HOURS * i FOR i IN range(3)]) AS w FROM events
    ) GROUP BY ALL
""")
def stream_sliding_windows(spark, sf_dir):
    """Events by type in windows of six hours that begin every two."""
    e = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    end = e.agg(F.max("ts").alias("ts")).select(F.lit("end").alias("event_type"), (F.coalesce("ts", F.lit("2024-01-01").cast("timestamp")) + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    with folder(spark, "windows") as path:
        stream = replayed(e.unionByName(end), f"{path}/in", "ts", SLICES)
        got = run_through(ingest.windowed_counts(stream, "6 hours", slide="2 hours", by=["event_type"]), path)
        return cut(got.where("event_type <> 'end'").select("event_type", F.unix_micros("window.start").alias("starts"), "n"))


@query("SELECT user_id AS tab_id, count(*) AS visits, min(event_id) AS first FROM events GROUP BY 1")
def stream_merge_once(spark, sf_dir):
    """Every event is sent again ten days later under the same id; the first stays."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("tab_id"), F.col("ts").cast("timestamp").alias("ts"))
    again = e.withColumn("ts", F.col("ts") + F.expr("INTERVAL 10 DAYS"))
    with folder(spark, "merge") as path:
        stream = replayed(e.unionByName(again), f"{path}/in", "ts", SLICES)
        ingest.merge_once(stream, f"{path}/out", f"{path}/log", "event_id").awaitTermination()
        kept = spark.read.schema(e.schema).parquet(f"{path}/out")
        return cut(kept.groupBy("tab_id").agg(F.count("*").alias("visits"), F.min("event_id").alias("first")))
