"""The Python API, rule sets as JSON, and searches of other forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import api
from ..operators import rules, tabs, vectors
from ..sources import tables
from .browsing import ANALYSIS, VISITS
from .registry import query
from .search import DISTANCE, MATCHES, RULES, _leaf, _query


@query("SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 2 AND n_nationkey > 8")
def sql_positional(spark, sf_dir):
    return api.Store(spark, sf_dir).sql("SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = ? AND n_nationkey > ?", [2, 8])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 3 ORDER BY n_nationkey DESC LIMIT 1")
def sql_first_row(spark, sf_dir):
    one = "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = ? ORDER BY n_nationkey DESC"
    store = api.Store(spark, sf_dir)
    row = store.first(one, [3])
    return spark.createDataFrame([row] if row else [], store.sql(one, [3]).schema)


@query(f"""
    WITH {DISTANCE}, {ANALYSIS}, hits AS (
        SELECT key, url, title, dist, summary FROM d JOIN analysis a ON d.key = a.page_id WHERE label <> 3 ORDER BY dist, key LIMIT 10
    )
    SELECT key AS id, url, title, round(dist, 6) AS score, substr(summary, 1, 200) || '...' AS preview FROM hits
""")
def semantic_search(spark, sf_dir):
    v = tables.vectors(spark, sf_dir)
    pages = tables.page_analysis(spark, sf_dir).select(F.col("page_id").alias("key"), "url", "title", F.col("summary").alias("page_content"))
    hits = api.semantic_search(v.join(pages, "key"), _query(v), 10, {"label": {"!=": 3}})
    return hits.withColumn("score", F.round("score", 6))


@query("SELECT vec_id AS key, label FROM embeddings WHERE label = 2 ORDER BY vec_id LIMIT 7")
def unqueried_scan(spark, sf_dir):
    return vectors.search(tables.vectors(spark, sf_dir), None, 7, {"label": 2}).select("key", "label")


@query(f"""
    WITH {DISTANCE}, near AS (SELECT * FROM d ORDER BY dist, key LIMIT 9)
    SELECT key, round(dist, 6) AS distance FROM near WHERE key % 2 = 0 ORDER BY dist, key LIMIT 3
""")
def notes_similar(spark, sf_dir):
    """Nearest notes without regard to age; odd ones have no body."""
    v = tables.vectors(spark, sf_dir).withColumn("body", F.when(F.col("key") % 2 == 0, F.col("label").cast("string")))
    return vectors.similar_notes(v, _query(v)).select("key", F.round("_distance", 6).alias("distance"))


@query(f"WITH {MATCHES} SELECT f.page_id, CAST(count(m.rule_id) AS INTEGER) AS hits FROM f LEFT JOIN m ON f.page_id = m.page_id GROUP BY f.page_id")
def rules_import(spark, sf_dir):
    """Rules exported as JSON and imported under new ids match the same pages."""
    f = tables.page_features(spark, sf_dir)
    return f.select("page_id", F.size(rules.matches(rules.import_rules(rules.export_rules(RULES)), f)).alias("hits"))


@query("""
    SELECT event_id, event_type = 'click' AS leaf, true AS compat, event_type = 'view' AS nested, true AS absent FROM events
""")
def rule_leaf_forms(spark, sf_dir):
    """A leaf that also names an operator, and paths into structs."""
    e = tables.table(spark, sf_dir, "events").select("event_id", "event_type", F.struct(F.col("event_type").alias("kind")).alias("page"))
    both = {"operator": "and", **_leaf("event_type", "equals", "click")}
    made = lambda c, compat=False: rules.compile_condition(c, e.schema, compat)
    return e.select(
        "event_id", made(both).alias("leaf"), made(both, True).alias("compat"), made(_leaf("page.kind", "equals", "view")).alias("nested"),
        made(_leaf("page.none", "contains", "undef")).alias("absent"),
    )


@query(f"""
    WITH {VISITS}, r AS (SELECT *, row_number() OVER (PARTITION BY tab_id, url ORDER BY ts, event_id) AS n FROM visits)
    SELECT event_type AS trigger, count(*) AS navigations, count(DISTINCT tab_id) AS tabs FROM r WHERE n = 1 GROUP BY 1
""")
def nav_triggers(spark, sf_dir):
    """What set off the navigations that count."""
    return tabs.first_navigations(tables.visits(spark, sf_dir)).groupBy(F.col("event_type").alias("trigger")).agg(
        F.count("*").alias("navigations"), F.countDistinct("tab_id").alias("tabs")
    )
