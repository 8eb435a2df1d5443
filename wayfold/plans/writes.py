"""Tables written and read back, file formats, set operations and further joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import bare_urls
from ..operators import decisions, episodes, rules, upserts, vectors
from ..session import cut, remove, shared_dir
from ..sources import ingest, tables
from ..sources.store import VersionedTable
from .memory import CONFIG, _similar
from .registry import query


class _Scratch:
    """A path in the shared folder, gone at the end."""

    def __init__(self, spark):
        self.spark, self.path = spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"

    def __enter__(self):
        return self.path

    def __exit__(self, *_):
        remove(self.spark, self.path)


@query("""
    SELECT doc_id AS key, source, CASE WHEN doc_id % 3 = 0 THEN 'new ' || source ELSE lang END AS value FROM documents WHERE doc_id % 5 <> 0
""")
def store_kv_put_delete(spark, sf_dir):
    """Create, insert, put over some keys, delete others, read back; partitioned by source, sorted by key."""
    d = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "source", F.col("lang").alias("value"))
    with _Scratch(spark) as path:
        kv = VersionedTable(spark, path, ["source"], ["key"])
        kv.create("key long, source string, value string")
        kv.insert(d)
        kv.put(d.where("key % 3 = 0").withColumn("value", F.concat(F.lit("new "), "source")), ["key"])
        kv.delete(d.where("key % 5 = 0").select("key"))
        return cut(kv.read().select("key", "source", "value"))


@query("""
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey AS BIGINT) END AS parent_id, o_orderstatus AS state FROM orders
""")
def store_session_parent(spark, sf_dir):
    """A session's parent set later; an unknown session changes nothing."""
    o = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("o_orderstatus").alias("state"), "o_custkey")
    changes = o.where("id % 4 = 0").select("id", F.col("o_custkey").cast("long").alias("parent_id"))
    unknown = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(1).cast("long").alias("parent_id"))
    with _Scratch(spark) as path:
        sessions = VersionedTable(spark, path, sort=["id"])
        sessions.create("id long, parent_id long, state string")
        sessions.insert(o.drop("o_custkey"))
        sessions.update(changes.unionByName(unknown), ["id"])
        return cut(sessions.read())


@query("SELECT doc_id AS id, source AS domain, doc_id % 3 <> 0 AS original_decision FROM documents")
def store_episode_insert(spark, sf_dir):
    """Episodes kept, then decisions of the same ids put over them once more: each id once."""
    e = episodes_of(spark, sf_dir)
    with _Scratch(spark) as path:
        kept = VersionedTable(spark, path, ["domain"], ["id"])
        kept.create(e.schema)
        kept.insert(e.where("id % 2 = 0"))
        kept.put(e, ["id"])
        return cut(kept.read().select("id", "domain", "original_decision"))


def episodes_of(spark, sf_dir):
    return tables.episodes(spark, sf_dir).select("id", "domain", "original_decision")


@query("""
    SELECT p_partkey AS id, p_name AS name,
           CAST(CASE WHEN p_partkey % 3 = 0 THEN 1000 - p_size ELSE p_size END AS INTEGER) AS priority, p_partkey % 4 <> 0 AS enabled
    FROM part WHERE p_partkey % 7 <> 0
""")
def store_rule_crud(spark, sf_dir):
    """A rule for each part: created, priorities changed twice in one change set, some disabled, others deleted; an unknown rule is an error."""
    p = tables.table(spark, sf_dir, "part")
    made = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("priority"), F.lit(True).alias("enabled"))
    third = made.where("id % 3 = 0")
    twice = third.select("id", F.lit(-1).alias("priority"), F.lit(1).alias("said")).unionByName(third.select("id", (1000 - F.col("priority")).alias("priority"), F.lit(2).alias("said")))
    with _Scratch(spark) as path:
        kept = VersionedTable(spark, path, sort=["id"])
        kept.create(made.schema)
        kept.insert(made)
        kept.update(twice, ["id"], ["said"], known=True)
        kept.update(made.where("id % 4 = 0").select("id", F.lit(False).alias("enabled")), ["id"], known=True)
        kept.delete(made.where("id % 7 = 0").select("id"), known=True)
        try:
            kept.update(made.limit(1).select((-F.col("id") - 1).alias("id"), F.lit(0).alias("priority")), ["id"], known=True)
        except KeyError:
            return cut(kept.read())
        raise AssertionError("an unknown rule was updated")


@query("""
    WITH k AS (SELECT CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END AS key, event_id, event_type FROM events), w AS (
        SELECT key, max_by(event_type, event_id) AS value, max(event_id) AS written FROM k GROUP BY key
    )
    SELECT key, value, written, (SELECT count(*) FROM w) AS keys FROM w WHERE key IS NULL OR key % 3 <> 0
""")
def store_repeated_keys(spark, sf_dir):
    """A change set that repeats keys, null among them, put twice: a row a key. Then some keys are deleted and the null one put back."""
    e = tables.table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("written"))
    with _Scratch(spark) as path:
        kv = VersionedTable(spark, path, sort=["key"])
        kv.create(e.schema)
        kv.put(e, ["key"], ["written"])
        kv.put(e.where("written % 2 = 0"), ["key"], ["written"])
        kv.put(e, ["key"], ["written"])
        keys = kv.read().count()
        kv.delete(e.where("key % 3 = 0 OR key IS NULL").select("key"))
        kv.put(e.where("key IS NULL"), ["key"], ["written"])
        return cut(kv.read().withColumn("keys", F.lit(keys)))


@query("""
    SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey + 10 ELSE s_nationkey END AS latest_activity_time FROM supplier
""")
def tree_time_advance(spark, sf_dir):
    """Times move forward only, and an unknown tree is not made."""
    s = tables.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("latest_activity_time"))
    step = F.when(F.col("id") % 2 == 0, F.col("latest_activity_time") + 10).otherwise(F.col("latest_activity_time") - 10)
    changes = s.withColumn("latest_activity_time", step).unionByName(s.limit(1).select(F.lit(-5).cast("long").alias("id"), "latest_activity_time"))
    return upserts.advance_trees(s, changes)


@query("""
    SELECT c_custkey AS tree_id, c_nationkey AS session_id,
           CASE WHEN c_custkey % 2 = 0 THEN 'changed' ELSE c_mktsegment END AS intentions FROM customer
    UNION ALL SELECT c_custkey, c_nationkey + 100, 'new' FROM customer WHERE c_custkey % 7 = 0
""")
def upsert_tree_intentions(spark, sf_dir):
    """By the composite key of tree and session."""
    c = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tree_id"), F.col("c_nationkey").alias("session_id"), F.col("c_mktsegment").alias("intentions"))
    changes = c.where("tree_id % 2 = 0").withColumn("intentions", F.lit("changed")).unionByName(
        c.where("tree_id % 7 = 0").select("tree_id", (F.col("session_id") + 100).alias("session_id"), F.lit("new").alias("intentions"))
    )
    return upserts.upsert(c, changes, ["tree_id", "session_id"])


@query("""
    SELECT CASE WHEN event_id % 10 = 0 THEN 'url is missing' WHEN event_id % 10 = 1 THEN 'page_loaded_at is no time'
                WHEN event_id % 10 = 2 THEN 'not a visit object' ELSE 'accepted' END AS state, count(*) AS n FROM events GROUP BY 1
""")
def ingest_visits(spark, sf_dir):
    """JSON messages to accepted and rejected visits."""
    e = tables.table(spark, sf_dir, "events")
    kind = F.col("event_id") % 10
    body = F.to_json(F.struct(
        F.when(kind != 0, F.concat(F.lit("https://x.org/"), F.col("user_id").cast("string"))).alias("url"),
        F.when(kind == 1, "soon").otherwise("2024-01-02T03:04:05Z").alias("page_loaded_at"),
    ))
    good, bad = ingest.parse_visits(e.select(F.when(kind == 2, "{broken").otherwise(body).alias("value")), decode=False)
    return good.select(F.lit("accepted").alias("state")).unionByName(bad.select(F.col("reason").alias("state"))).groupBy("state").agg(F.count("*").alias("n"))


@query("""
    SELECT page_id, len(regexp_extract_all(html, 'https?://[^\\s)\\]]+')) AS n FROM pages
""")
def bare_url_count(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages").select("page_id", F.size(bare_urls(F.col("html"))).cast("long").alias("n"))


@query("""
    WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0), d AS (
        SELECT vec_id AS key, list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), (SELECT v FROM q)), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist FROM embeddings
    ), hits AS (SELECT * FROM d ORDER BY dist, key LIMIT 5)
    SELECT h.key AS id, e.source AS domain, round(h.dist, 6) AS distance FROM hits h JOIN documents e ON h.key = e.doc_id
""")
def similar_episodes(spark, sf_dir):
    """The episodes of the five nearest vectors."""
    v = tables.vectors(spark, sf_dir)
    hits = vectors.search(v, v.where("key = 0").head()["vector"], 5)
    return vectors.similar_to_episodes(hits, tables.episodes(spark, sf_dir)).select("id", "domain", F.round("_distance", 6).alias("distance"))


def memory_second_gate(spark, sf_dir):
    e = tables.episodes(spark, sf_dir)
    pages = e.select("id", "domain", "page_type", "confidence", F.col("original_decision").alias("model"))
    m = decisions.memory_adjusted(pages, _similar(e, 5), episodes.domain_majority(e), CONFIG)
    m = m.withColumn("adjusted_confidence", F.round("adjusted_confidence", 6))
    return decisions.second_gate(m, CONFIG).select("id", "adjusted_type", "adjusted_confidence", "processed")


def _second_gate_sql() -> str:
    from .registry import ORACLES

    head, _, _ = ORACLES["memory_adjust"].rpartition("SELECT id, adjusted_type")
    return head + """
        SELECT id, adjusted_type, round(adjusted_confidence, 6) AS adjusted_confidence,
               adjusted_type = 'knowledge' AND round(adjusted_confidence, 6) >= 0.7 AND coalesce(override, original_decision) AS processed FROM k
    """


query(_second_gate_sql())(memory_second_gate)


@query("""
    SELECT 'union' AS kind, count(*) AS n FROM (SELECT lang FROM documents UNION SELECT o_orderstatus FROM orders)
    UNION ALL SELECT 'all', count(*) FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels)
    UNION ALL SELECT 'intersect', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
    UNION ALL SELECT 'except', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
""")
def set_operations(spark, sf_dir):
    d, lab, o = (tables.table(spark, sf_dir, n) for n in ("documents", "labels", "orders"))
    a, b = d.select("doc_id"), lab.select("doc_id")
    made = {
        "union": d.select("lang").union(o.select("o_orderstatus")).distinct(), "all": a.unionAll(b), "intersect": a.intersect(b), "except": a.subtract(b),
    }
    out = None
    for kind, rows in made.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
    SELECT c_nationkey, c_mktsegment, count(*) AS n, grouping(c_nationkey, c_mktsegment) AS level FROM customer GROUP BY CUBE (c_nationkey, c_mktsegment)
""")
def cube_upgrade(spark, sf_dir):
    c = tables.table(spark, sf_dir, "customer")
    return c.cube("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("""
    SELECT 'left' AS kind, count(*) AS n, count(quality) AS matched FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    UNION ALL SELECT 'right', count(*), count(d.doc_id) FROM documents d RIGHT JOIN labels l ON d.doc_id = l.doc_id + 10
    UNION ALL SELECT 'full', count(*), count(quality) FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id + 10
""")
def outer_joins(spark, sf_dir):
    d, lab = tables.table(spark, sf_dir, "documents").select("doc_id"), tables.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id"), "quality")
    kinds = (("left", F.col("doc_id") == F.col("l_id"), "quality"), ("right", F.col("doc_id") == F.col("l_id") + 10, "doc_id"), ("full", F.col("doc_id") == F.col("l_id") + 10, "quality"))
    out = None
    for kind, on, matched in kinds:
        one = d.join(lab, on, kind).agg(F.count("*").alias("n"), F.count(matched).alias("matched")).select(F.lit(kind).alias("kind"), "n", "matched")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
    SELECT f AS format, n_nationkey, n_name, n_regionkey FROM nation, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) t(f)
""")
def scan_formats(spark, sf_dir):
    """A table written in four formats and read back by its schema."""
    n = tables.table(spark, sf_dir, "nation")
    with _Scratch(spark) as path:
        out = None
        for f in ("csv", "json", "orc", "parquet"):
            n.write.format(f).save(f"{path}/{f}")
            one = spark.read.schema(n.schema).format(f).load(f"{path}/{f}").withColumn("format", F.lit(f))
            out = one if out is None else out.unionByName(one)
        return cut(out)


@query("""
    SELECT event_id, event_type = 'click' AND value > 10 AS both, value > 10 AS more, false AS kinds_differ, false AS no_number, event_id = 7 AS same FROM events
""")
def rule_value_kinds(spark, sf_dir):
    """Rules whose values are of other kinds than the fields."""
    e = tables.table(spark, sf_dir, "events")
    leaf = lambda field, comparator, value: rules.compile_condition({"field": field, "comparator": comparator, "value": value}, e.schema)
    return e.select(
        "event_id", (leaf("event_type", "equals", "click") & leaf("value", "greater_than", "10")).alias("both"), leaf("value", "greater_than", 10).alias("more"),
        (leaf("event_type", "equals", 5) | leaf("event_id", "equals", "7")).alias("kinds_differ"), leaf("value", "less_than", "many").alias("no_number"),
        leaf("event_id", "equals", 7).alias("same"),
    )
