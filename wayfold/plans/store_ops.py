"""Ordered batches of store operations, and vector namespaces searched by many queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batches, namespaces
from ..session import cut
from ..sources import tables
from ..streaming.replay import folder
from .registry import query


def _log(spark, sf_dir):
    """Events as operations on the vectors' keys, every tenth of an unknown kind; puts and searches carry the key's own vector."""
    e = tables.table(spark, sf_dir, "events")
    v = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vector"))
    kind = F.element_at(F.create_map(*[F.lit(x) for p in (("click", "get"), ("view", "put"), ("error", "delete"), ("signup", "search")) for x in p]), F.col("event_type"))
    kind = F.when(F.col("event_id") % 10 == 3, F.lit("upsert")).otherwise(F.coalesce(kind, F.lit("get")))
    key = F.col("user_id") % 97
    log = e.select(F.col("event_id").alias("seq"), kind.alias("kind"), key.alias("key"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("value"))
    held = v.where("key % 2 = 0").select("key", F.concat(F.lit("held "), F.col("key").cast("string")).alias("value"), "vector")
    carried = F.when(F.col("kind").isin("put", "search"), F.col("vector"))
    named = F.broadcast(v.where("abs(key) < 97"))  # the only keys that the log names
    return held, log.join(named, "key", "left").withColumn("vector", carried)


LOG = """
    v AS (SELECT vec_id AS key, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings), log AS (
        SELECT event_id AS seq, user_id % 97 AS key, 'v' || event_id AS value,
               CASE WHEN event_id % 10 = 3 THEN 'upsert' WHEN event_type = 'view' THEN 'put' WHEN event_type = 'error' THEN 'delete'
                    WHEN event_type = 'signup' THEN 'search' ELSE 'get' END AS kind
        FROM events
    ), writes AS (
        SELECT key, CAST(-1 AS BIGINT) AS seq, false AS deleted, 'held ' || key AS value FROM v WHERE key % 2 = 0
        UNION ALL SELECT key, seq, kind = 'delete', value FROM log WHERE kind IN ('put', 'delete')
    )
"""


@query(f"""
    WITH {LOG}, seen AS (
        SELECT g.seq, g.key, arg_max(w.deleted, w.seq) AS deleted, arg_max(w.value, w.seq) AS value
        FROM log g LEFT JOIN writes w ON w.key = g.key AND w.seq < g.seq WHERE g.kind = 'get' GROUP BY g.seq, g.key
    )
    SELECT seq, key, coalesce(NOT deleted, false) AS found, CASE WHEN NOT deleted THEN value END AS value FROM seen
    UNION ALL SELECT seq, key, false, 'Unknown operation type: ' || kind FROM log WHERE kind = 'upsert'
""")
def batch_gets(spark, sf_dir):
    """What each get of the log saw, the puts and deletes before it included; unknown kinds are told."""
    held, log = _log(spark, sf_dir)
    known, rejected = batches.checked(cut(log))
    return batches.gets(held, known).unionByName(rejected.select("seq", "key", F.lit(False).alias("found"), F.col("reason").alias("value")))


@query(f"WITH {LOG}, last AS (SELECT key, arg_max(deleted, seq) AS deleted, arg_max(value, seq) AS value FROM writes GROUP BY key) SELECT key, value FROM last WHERE NOT deleted")
def batch_remaining(spark, sf_dir):
    held, log = _log(spark, sf_dir)
    return batches.remaining(held, batches.checked(log)[0]).select("key", "value")


@query(f"""
    WITH {LOG}, spans AS (
        SELECT w.key, w.deleted, w.seq AS since, lead(w.seq, 1, 9223372036854775807) OVER (PARTITION BY w.key ORDER BY w.seq) AS until FROM writes w
    ), d AS (
        SELECT s.seq, p.key, list_sum(list_transform(list_zip(a.vector, b.vector), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS dist
        FROM log s JOIN v a ON a.key = s.key JOIN spans p ON NOT p.deleted AND p.since < s.seq AND s.seq < p.until JOIN v b ON b.key = p.key
        WHERE s.kind = 'search'
    ), r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY dist, key) AS n FROM d)
    SELECT seq, CAST(n AS INTEGER) AS rank, key, round(dist, 6) AS distance FROM r WHERE n <= 3
""")
def batch_searches(spark, sf_dir):
    """The three rows nearest to each search of the log among those that the store held just then."""
    held, log = _log(spark, sf_dir)
    known = batches.checked(log)[0]
    return batches.searches(held, known, 3).select("seq", "rank", "key", F.round("distance", 6).alias("distance"))


EXACT = """
    v AS (SELECT vec_id AS key, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (
        SELECT a.key AS ask, b.key, list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist
        FROM v a JOIN v b ON b.label < 5 WHERE a.key % 10 = 0
    ), r AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY dist, key) AS n FROM d)
"""


def _asked(v):
    return v.where("key % 10 = 0").select(F.col("key").alias("ask"), "vector")


@query(f"WITH {EXACT} SELECT ask, CAST(n AS INTEGER) AS rank, key, round(dist, 6) AS distance FROM r WHERE n <= 5")
def knn_many(spark, sf_dir):
    """Every tenth vector as a query: its five nearest of some labels, from a kept namespace with all lists probed."""
    v = tables.vectors(spark, sf_dir)
    with folder(spark, "namespace") as path:
        kept = namespaces.VectorNamespace(spark, path)
        kept.build(v)
        got = kept.search(_asked(v), 5, namespaces.MOST_LISTS, {"label": {"<": 5}})
        return cut(got.select("ask", "rank", "key", F.round("_distance", 6).alias("distance")))


@query("SELECT count(*) FILTER (vec_id % 10 = 0) AS asks, true AS enough, true AS fewer_rows FROM embeddings")
def namespace_recall(spark, sf_dir):
    """A namespace searched with a part of its lists against brute force: recall at 10 is 0.9 or more, and fewer rows are read."""
    v = tables.vectors(spark, sf_dir)
    with folder(spark, "namespace") as path:
        kept = namespaces.VectorNamespace(spark, path)
        kept.build(v)
        probes = max(1, round(0.5 * len(kept.centroids())))
        got = cut(kept.search(_asked(v), 10, probes))
        lists = kept.rows().groupBy("list").agg(F.count("*").alias("n"))
        read = _asked(v).select("ask", F.explode(namespaces._closest(kept.centroids(), probes, "vector")).alias("list")).join(lists, "list").agg(F.sum("n").alias("read"))
        out = namespaces.recall(got, namespaces.search_many(v, _asked(v), 10))
        all_pairs = v.agg(F.count("*").alias("rows"))
        return cut(out.join(F.broadcast(read)).join(F.broadcast(all_pairs)).select(
            "asks", (F.col("recall") >= 0.9).alias("enough"), (F.col("read") < 0.9 * F.col("rows") * F.col("asks")).alias("fewer_rows")
        ))
