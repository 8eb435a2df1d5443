"""Contents for retrieval, previews, navigation logs, and tables laid out for what is looked up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import navigation
from ..operators import tabs, vectors
from ..session import cut
from ..sources import tables
from ..sources.store import VersionedTable
from .browsing import ANALYSIS, VISITS
from .registry import query
from .writes import _Scratch


@query(f"""
    WITH {ANALYSIS}
    SELECT a.page_id AS key, a.title, coalesce(d.text, '') AS content
    FROM analysis a LEFT JOIN (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) d ON a.page_id = d.doc_id
""")
def rag_pages(spark, sf_dir):
    """Title and content of every analysed page; only labelled documents have a content."""
    kept = tables.table(spark, sf_dir, "documents").join(tables.table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    titles = tables.page_analysis(spark, sf_dir).select(F.col("page_id").alias("key"), "title")
    return vectors.with_contents(titles, kept.select(F.col("doc_id").alias("key"), F.col("text").alias("content")))


@query("SELECT vec_id AS key, label FROM embeddings ORDER BY vec_id LIMIT 5")
def namespace_preview(spark, sf_dir):
    return vectors.preview(tables.vectors(spark, sf_dir)).select("key", "label")


LOGGED = f"""
    {VISITS}, logs AS (
        SELECT event_id, tab_id, ts, CASE event_type
            WHEN 'click' THEN 'visit URL: ' || url || ', referrer: ' || coalesce(referrer, '')
            WHEN 'view' THEN 'page_load reload url ' || url
            WHEN 'signup' THEN 'navigation new_tab back url:' || url || ' referrer:none'
            WHEN 'purchase' THEN 'navigation by pushState'
            ELSE 'visit reload spa url ' || url END AS message
        FROM visits
    ), parsed AS (
        SELECT event_id, tab_id, ts, nullif(regexp_extract(message, '(?i)url[:\\s]+([^\\s,]+)', 1), '') AS url,
               nullif(regexp_extract(message, '(?i)referrer[:\\s]+([^\\s,]+)', 1), '') AS referrer,
               CASE WHEN contains(message, 'back') OR contains(message, 'forward') THEN 'back_forward'
                    WHEN contains(message, 'reload') THEN 'reload' ELSE 'navigate' END AS navigation_type,
               contains(message, 'pushState') OR contains(message, 'replaceState') OR contains(message, 'spa') AS is_spa,
               contains(message, 'new_tab') OR contains(message, 'target="_blank"') AS is_new_tab
        FROM logs WHERE contains(message, 'navigation') OR contains(message, 'visit') OR contains(message, 'page_load')
    ), navigations AS (SELECT * FROM parsed WHERE url IS NOT NULL)
"""


def _navigations(spark, sf_dir):
    v, kind = tables.visits(spark, sf_dir), F.col("event_type")
    message = (
        F.when(kind == "click", F.concat(F.lit("visit URL: "), "url", F.lit(", referrer: "), F.coalesce("referrer", F.lit(""))))
        .when(kind == "view", F.concat(F.lit("page_load reload url "), "url"))
        .when(kind == "signup", F.concat(F.lit("navigation new_tab back url:"), "url", F.lit(" referrer:none")))
        .when(kind == "purchase", F.lit("navigation by pushState"))
        .otherwise(F.concat(F.lit("visit reload spa url "), "url"))
    )
    return v.select("event_id", "tab_id", "ts", navigation(message).alias("n")).where("n IS NOT NULL").select("event_id", "tab_id", "ts", "n.*")


@query(f"WITH {LOGGED} SELECT event_id, url, referrer, navigation_type, is_spa, is_new_tab FROM navigations")
def navigation_logs(spark, sf_dir):
    """Navigations parsed from log lines."""
    return _navigations(spark, sf_dir).drop("tab_id", "ts")


@query(f"""
    WITH {LOGGED}
    SELECT tab_id, count(*) AS total_events, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS duration_ms, count(DISTINCT url) AS unique_urls,
           count(*) FILTER (WHERE is_spa) AS spa_navigations, count(*) FILTER (WHERE is_new_tab) AS new_tabs
    FROM navigations GROUP BY tab_id
""")
def navigation_chain_stats(spark, sf_dir):
    return tabs.navigation_statistics(_navigations(spark, sf_dir))


@query(f"WITH {VISITS} SELECT id, url, tab_id FROM visits WHERE event_type = 'view' AND url >= 'https://view.example.com/5'")
def store_layout(spark, sf_dir):
    """Visits partitioned by kind and sorted by URL: a look-up prunes partitions and row groups."""
    with _Scratch(spark) as path:
        t = VersionedTable(spark, path, ["event_type"], ["url"])
        v = tables.visits(spark, sf_dir).select("id", "url", "tab_id", "event_type")
        t.create(v.schema)
        t.insert(v)
        found = t.read().where((F.col("event_type") == "view") & (F.col("url") >= "https://view.example.com/5"))
        return cut(found.select("id", "url", "tab_id"))
