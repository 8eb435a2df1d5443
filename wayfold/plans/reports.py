"""Trees hung from their first root, the review document, and results with their order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import episodes, order, trees, upserts, vectors
from ..sources import tables
from .browsing import EDGES, edges, links, named, numbered_visits, visit_id
from .memory import EPISODES, NOW, REASON
from .registry import query
from .search import DISTANCE, _query


@query(f"""
    WITH RECURSIVE {EDGES}, m AS (SELECT tab_id AS tree_id, id, parent_id, page_loaded_at FROM edges), hung AS (
        SELECT m.tree_id, m.id, m.page_loaded_at, p.id AS parent_id FROM m LEFT JOIN m p ON p.tree_id = m.tree_id AND p.id = m.parent_id
    ), first AS (
        SELECT tree_id, arg_min(id, (page_loaded_at, id)) AS root_id FROM hung WHERE parent_id IS NULL GROUP BY tree_id
    ), below(tree_id, root_id, id) AS (
        SELECT tree_id, root_id, root_id FROM first
        UNION ALL
        SELECT h.tree_id, b.root_id, h.id FROM hung h JOIN below b ON h.tree_id = b.tree_id AND h.parent_id = b.id
    )
    SELECT h.tree_id, b.root_id, h.parent_id, h.id, CAST(row_number() OVER (PARTITION BY h.tree_id, h.parent_id ORDER BY h.page_loaded_at, h.id) - 1 AS INTEGER) AS nth
    FROM hung h JOIN below b ON h.tree_id = b.tree_id AND h.id = b.id
""")
def tree_built(spark, sf_dir):
    """A tab's visits as one tree: parents in other tabs do not count, and what hangs from later roots is left out."""
    v = numbered_visits(spark, sf_dir, ["tab_id"])
    if "twice" in v.columns:  # a visit in several tabs has several places
        return trees.built(edges(spark, sf_dir, ["tab_id", "page_loaded_at"]).withColumnRenamed("tab_id", "tree_id"))
    up = v.select(F.col("n").alias("up"), F.col("tab_id").alias("_t"))
    inside = links(v).join(v.select("n", "tab_id"), "n").join(up, "up").where("tab_id = _t").select("n", "up")
    placed = trees.hung(v.withColumnRenamed("tab_id", "tree_id").drop("referrer"), inside, F.floor(F.col("at") / 86_400_000_000), ["at", visit_id()])
    return named(placed, v, root="root_id", up="parent_id").select("tree_id", "root_id", "parent_id", visit_id().alias("id"), "nth")


REVIEW = f"""
    {EPISODES}, said AS (
        SELECT *, {REASON} AS reason, CASE WHEN correction_timestamp IS NOT NULL THEN ' ⚠️' ELSE '' END AS mark,
               '[' || coalesce(title, '') || '](' || url || ')' AS link
        FROM episodes
    ), one AS (
        SELECT *, row_number() OVER (ORDER BY timestamp DESC, id) - 1 AS at_ FROM said WHERE original_decision AND timestamp >= TIMESTAMP '{NOW}' - INTERVAL 7 DAYS
    ), two AS (
        SELECT *, row_number() OVER (ORDER BY timestamp DESC, id) - 1 AS at_ FROM said WHERE NOT original_decision AND timestamp >= TIMESTAMP '{NOW}' - INTERVAL 48 HOURS
    ), whole AS (
        SELECT 0 AS section, i AS position, ['# Webpage Review', '', '> Generated: {NOW}', '',
               'Stats: ' || n || ' total pages | ' || c || ' corrections | ' || printf('%.1f', CASE WHEN n > 0 THEN c / n * 100 ELSE 0 END) || '% correction rate', ''][i + 1] AS line
        FROM (SELECT count(*) AS n, count(correction_timestamp) AS c FROM episodes), range(6) r(i)
        UNION ALL SELECT 1, i, ['## Recent webpages', '', CASE WHEN (SELECT count(*) FROM one) > 0 THEN '*Accepted pages from the last 7 days*' ELSE '*No accepted pages in the last 7 days*' END, ''][i + 1] FROM range(4) r(i)
        UNION ALL SELECT 2, i, ['## Filtered out webpages', '', CASE WHEN (SELECT count(*) FROM two) > 0 THEN '*Filtered pages from the last 48 hours*' ELSE '*No filtered pages in the last 48 hours*' END, ''][i + 1] FROM range(4) r(i)
        UNION ALL SELECT 1, 4 + 3 * at_ + i, ['- ' || link || mark, '  ' || reason, ''][i + 1] FROM one, range(3) r(i)
        UNION ALL SELECT 2, 4 + 3 * at_ + i, ['- ~~' || link || '~~' || mark, '  ' || reason, ''][i + 1] FROM two, range(3) r(i)
        UNION ALL SELECT 3, i, ['', '---', '', '**Legend**: ⚠️ = User corrected', '', '*Recent pages are shown for 7 days, filtered pages for 48 hours*'][i + 1] FROM range(6) r(i)
    )
"""


@query(f"WITH {REVIEW} SELECT CAST(section AS INTEGER) AS section, CAST(position AS BIGINT) AS position, line FROM whole")
def review_document(spark, sf_dir):
    """The whole review, line by line in its order: statistics, seven days of accepted pages, two of filtered ones, legend."""
    return episodes.review_document(tables.episodes(spark, sf_dir), F.lit(NOW).cast("timestamp"))


@query("SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) - 1 AS position FROM events")
def newest_first(spark, sf_dir):
    """Every event's place in its type, the newest first: the order itself is the result."""
    e = tables.table(spark, sf_dir, "events").select("event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return order.numbered(e, ["event_type"], F.to_date("ts"), [F.desc("ts"), F.asc("event_id")], descending=True).select("event_type", "event_id", "position")


@query("""
    WITH h AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)
    SELECT source, lang, n, round(100.0 * n / sum(n) OVER (PARTITION BY source), 1) AS percent,
           CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) - 1 AS BIGINT) AS position
    FROM h
""")
def histogram_sorted(spark, sf_dir):
    """Languages of each source by count, the largest first, with their share."""
    h = tables.table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    total = h.groupBy(F.col("source").alias("_s")).agg(F.sum("n").alias("total"))
    placed = order.numbered(h, ["source"], F.floor(F.log2("n")), [F.desc("n"), F.asc("lang")], descending=True)
    return placed.join(total, F.col("source").eqNullSafe(F.col("_s"))).select("source", "lang", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("percent"), "position")


@query(f"""
    WITH {DISTANCE}, t AS (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_hours(key) AS updated_at FROM d),
    n AS (SELECT * FROM t WHERE updated_at >= TIMESTAMP '2024-01-09 12:00:00' ORDER BY dist, key LIMIT 25)
    SELECT key, round(0.7 / (1 + dist) + 0.3 * greatest(0, 1 - (epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(updated_at)) / 86400e6 / 30), 6) AS score
    FROM n ORDER BY score DESC, key LIMIT 5
""")
def notes_since(spark, sf_dir):
    """Notes by closeness and age, of those updated since a date."""
    v = tables.vectors(spark, sf_dir)
    dated = v.withColumn("updated_at", F.timestamp_add("HOUR", F.col("key").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")))
    now, since = (F.lit(t).cast("timestamp") for t in ("2024-01-20 00:00:00", "2024-01-09 12:00:00"))
    return vectors.rerank_by_recency(dated, _query(v), now, 5, min_date=since).select("key", F.round("score", 6).alias("score"))


@query("""
    WITH c AS (SELECT DISTINCT user_id * 2 AS id FROM events WHERE event_type = 'view')
    SELECT id, id NOT IN (SELECT user_id FROM events) AS was_new FROM c
""")
def upsert_was_new(spark, sf_dir):
    """Which of the changed keys an upsert inserts and which it replaces."""
    e = tables.table(spark, sf_dir, "events")
    kept = e.select(F.col("user_id").alias("id"), "event_type").dropDuplicates(["id"])
    changes = e.where("event_type = 'view'").select((F.col("user_id") * 2).alias("id"), "event_type")
    return upserts.upsert_flagged(kept, changes, ["id"])[1]
