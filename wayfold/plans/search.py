"""Vectors, rules, upserts, markdown and the SQL interface."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import api
from ..operators import decisions, markdown, rules, upserts, vectors
from ..sources import tables
from .memory import CONFIG
from .pages import HOST, TEXT, TITLE, WORDS
from .registry import query

DISTANCE = """
    q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0),
    d AS (
        SELECT vec_id AS key, label, list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), (SELECT v FROM q)), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist
        FROM embeddings
    )
"""


def _query(v):
    return v.where("key = 0").head()["vector"]


@query(f"WITH {DISTANCE} SELECT key, round(dist, 6) AS distance FROM d ORDER BY dist, key LIMIT 10")
def knn_l2(spark, sf_dir):
    v = tables.vectors(spark, sf_dir)
    return vectors.search(v, _query(v)).select("key", F.round("_distance", 6).alias("distance"))


@query(f"WITH {DISTANCE} SELECT key, label, round(dist, 6) AS distance FROM d WHERE label = 3 AND key >= 50 ORDER BY dist, key LIMIT 10")
def knn_filtered(spark, sf_dir):
    v = tables.vectors(spark, sf_dir)
    return vectors.search(v, _query(v), 10, {"label": 3, "key": {">=": 50}}).select("key", "label", F.round("_distance", 6).alias("distance"))


@query(f"""
    WITH {DISTANCE}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist, key) AS n FROM d)
    SELECT label, key, CAST(n AS INTEGER) AS rank FROM r WHERE n <= 3
""")
def knn_per_label(spark, sf_dir):
    v = tables.vectors(spark, sf_dir)
    return vectors.search_grouped(v, _query(v), "label", 3).select("label", "key", "rank")


@query(f"""
    WITH {DISTANCE}, t AS (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_hours(key) AS updated_at FROM d),
    n AS (SELECT * FROM t WHERE updated_at >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 15 DAYS ORDER BY dist, key LIMIT 25)
    SELECT key, round(0.7 / (1 + dist) + 0.3 * greatest(0, 1 - (epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(updated_at)) / 86400e6 / 30), 6) AS score
    FROM n ORDER BY score DESC, key LIMIT 5
""")
def notes_recency_rerank(spark, sf_dir):
    v = tables.vectors(spark, sf_dir)
    dated = v.withColumn("updated_at", F.timestamp_add("HOUR", F.col("key").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")))
    return vectors.rerank_by_recency(dated, _query(v), F.lit("2024-01-20 00:00:00").cast("timestamp"), 5, 15).select("key", F.round("score", 6).alias("score"))


@query("""
    WITH w AS (
        SELECT vec_id % 100 AS key, vec_id AS seq, vec_id % 7 = 0 AS deleted, label FROM embeddings
    ), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM w)
    SELECT key, label FROM r WHERE n = 1 AND NOT deleted
""")
def kv_latest_wins(spark, sf_dir):
    w = tables.vectors(spark, sf_dir).select(
        (F.col("key") % 100).alias("key"), F.col("key").alias("seq"), (F.col("key") % 7 == 0).alias("deleted"), "label",
        F.lit("2024-01-01").cast("timestamp").alias("written_at"),
    )
    return vectors.latest(w).select("key", "label")


@query("""
    WITH n AS (SELECT DISTINCT source || '/' || lang AS name FROM documents)
    SELECT name FROM n WHERE starts_with(name, 'src1') AND ends_with(name, 'r') ORDER BY name LIMIT 5 OFFSET 2
""")
def namespace_list(spark, sf_dir):
    names = tables.table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "lang").alias("name")).distinct()
    return vectors.namespaces(names, prefix="src1", suffix="r", limit=5, offset=2)


# ----------------------------------------------------------------------- rules
def _leaf(field, comparator, value):
    return {"field": field, "comparator": comparator, "value": value}


RULES = [
    {"id": "r1", "name": "blogs", "priority": 10, "action": {"type": "tag", "value": "blog"}, "condition": _leaf("url", "contains", "BLOG.")},
    {"id": "r2", "name": "org reject", "priority": 50, "action": {"type": "reject"},
     "condition": {"operator": "and", "conditions": [_leaf("domain", "ends_with", ".org"), _leaf("word_count", "less_than", 300)]}},
    {"id": "r3", "name": "long accept", "priority": 40, "action": {"type": "accept"},
     "condition": {"operator": "or", "conditions": [_leaf("word_count", "greater_than", 600), _leaf("url", "matches", r"page=\d+")]}},
    {"id": "r4", "name": "not plain", "priority": 60, "action": {"type": "priority_boost"},
     "condition": {"operator": "not", "conditions": [_leaf("url", "starts_with", "http://")]}},
    {"id": "r5", "name": "exact", "priority": 60, "action": {"type": "tag", "value": "seven"}, "condition": _leaf("page_id", "equals", 7)},
    {"id": "r6", "name": "off", "priority": 99, "enabled": False, "action": {"type": "reject"}, "condition": _leaf("url", "contains", "")},
]
FEATURES = f"f AS (SELECT page_id, url, {HOST} AS domain, {WORDS} AS word_count, {TEXT} AS plain FROM pages)"
MATCHES = f"""
    {FEATURES}, m AS (
        SELECT page_id, 'r4' AS rule_id, 0 AS nth, 'priority_boost' AS action FROM f WHERE NOT starts_with(lower(url), 'http://')
        UNION ALL SELECT page_id, 'r5', 1, 'tag' FROM f WHERE page_id = 7
        UNION ALL SELECT page_id, 'r2', 2, 'reject' FROM f WHERE ends_with(domain, '.org') AND word_count < 300
        UNION ALL SELECT page_id, 'r3', 3, 'accept' FROM f WHERE word_count > 600 OR regexp_matches(url, '(?i)page=\\d+')
        UNION ALL SELECT page_id, 'r1', 4, 'tag' FROM f WHERE contains(lower(url), 'blog.')
    ), stop AS (
        SELECT page_id, min(nth) AS nth FROM m WHERE action IN ('accept', 'reject') GROUP BY page_id
    ), used AS (
        SELECT m.* FROM m LEFT JOIN stop s ON m.page_id = s.page_id WHERE s.nth IS NULL OR m.nth <= s.nth
    )
"""


def _matched(spark, sf_dir):
    f = tables.page_features(spark, sf_dir)
    return f.withColumn("found", rules.matches(RULES, f)).withColumn("used", rules.applied(F.col("found")))


@query(f"WITH {MATCHES} SELECT page_id, rule_id FROM m")
def rule_match(spark, sf_dir):
    return _matched(spark, sf_dir).select("page_id", F.explode("found.id").alias("rule_id"))


@query(f"""
    WITH {MATCHES} SELECT f.page_id, max(action) FILTER (WHERE action IN ('accept', 'reject')) AS action,
        coalesce(string_agg(CASE rule_id WHEN 'r1' THEN 'blog' WHEN 'r5' THEN 'seven' END, ',' ORDER BY nth), '') AS tags,
        CAST(count(*) FILTER (WHERE action = 'priority_boost') AS INTEGER) AS boosts
    FROM f LEFT JOIN used u ON f.page_id = u.page_id GROUP BY f.page_id
""")
def rule_first_terminal(spark, sf_dir):
    o = _matched(spark, sf_dir).select("page_id", rules.outcome(F.col("used")).alias("o"))
    return o.select("page_id", "o.action", F.array_join("o.tags", ",").alias("tags"), "o.boosts")


@query(f"WITH {MATCHES} SELECT page_id, rule_id, action FROM used")
def rule_execution_log(spark, sf_dir):
    return rules.execution_log(_matched(spark, sf_dir), F.col("used"))


@query(f"""
    WITH {MATCHES}, r AS (
        SELECT unnest(['r1', 'r2', 'r3', 'r4', 'r5', 'r6']) AS id, unnest(['blogs', 'org reject', 'long accept', 'not plain', 'exact', 'off']) AS name,
               unnest([10, 50, 40, 60, 60, 99]) AS priority
    )
    SELECT r.id, r.name, r.priority, count(u.rule_id) AS executions, count(u.rule_id) AS matches, CAST(0 AS DOUBLE) AS average_ms
    FROM r LEFT JOIN used u ON r.id = u.rule_id GROUP BY ALL
""")
def rule_statistics(spark, sf_dir):
    table = spark.createDataFrame([(r["id"], r["name"], r["priority"]) for r in RULES], "id string, name string, priority int")
    log = rules.execution_log(_matched(spark, sf_dir), F.col("used")).withColumns({"matched": F.lit(True), "execution_time_ms": F.lit(0)})
    return rules.statistics(table, log)


@query(f"""
    WITH {MATCHES}, o AS (
        SELECT f.page_id, f.word_count, max(action) FILTER (WHERE action IN ('accept', 'reject')) AS action, count(*) FILTER (WHERE action = 'priority_boost') AS boosts
        FROM f LEFT JOIN used u ON f.page_id = u.page_id GROUP BY ALL
    ), c AS (
        SELECT *, CASE WHEN word_count > 150 THEN 'knowledge' ELSE 'other' END AS page_type, least(1, 0.5 + (page_id % 40) / 100 + 0.1 * boosts) AS raised FROM o
    ), b AS (SELECT *, round(CASE WHEN action IS NULL THEN greatest(0, least(1, raised - 0.04)) ELSE raised END, 6) AS confidence FROM c)
    SELECT page_id, confidence, CASE action WHEN 'reject' THEN false WHEN 'accept' THEN true ELSE page_type = 'knowledge' AND confidence >= 0.7 END AS decision,
           CASE WHEN action = 'reject' THEN 'rule_reject' WHEN action = 'accept' THEN 'rule_accept' WHEN page_type <> 'knowledge' THEN 'type_not_allowed'
                WHEN confidence < 0.7 THEN 'low_confidence' ELSE 'accepted' END AS reason
    FROM b
""")
def enhanced_decision(spark, sf_dir):
    m = _matched(spark, sf_dir).withColumn("o", rules.outcome(F.col("used"))).withColumns({
        "page_type": F.when(F.col("word_count") > 150, "knowledge").otherwise("other"),
        "base": 0.5 + (F.col("page_id") % 40) / 100,
    })
    # rounded before the threshold so that both engines compare the same number
    args = (F.col("page_type"), F.col("base"), F.lit(True), F.col("o.action"), F.col("o.boosts"), F.lit(-0.04))
    d = m.withColumn("d", decisions.enhanced_decision(*args, CONFIG)).withColumn("c", F.round("d.confidence", 6))
    again = decisions.enhanced_decision(F.col("page_type"), F.col("c"), F.lit(True), F.col("o.action"), F.lit(0), F.lit(0.0), CONFIG)
    return d.select("page_id", F.col("c").alias("confidence"), again.alias("e")).select("page_id", "confidence", "e.decision", "e.reason")


# --------------------------------------------------------------------- upserts
@query("""
    WITH c AS (SELECT page_id % 60 AS page_id, 'v' || page_id AS title, page_id AS seq FROM pages WHERE page_id % 2 = 0),
    l AS (SELECT page_id, arg_max(title, seq) AS title FROM c GROUP BY page_id)
    SELECT p.page_id, coalesce(l.title, 'old') AS title FROM (SELECT page_id FROM pages WHERE page_id >= 20) p LEFT JOIN l ON p.page_id = l.page_id
    UNION ALL SELECT l.page_id, l.title FROM l WHERE l.page_id < 20
""")
def upsert_latest_wins(spark, sf_dir):
    p = tables.table(spark, sf_dir, "pages")
    table = p.where("page_id >= 20").select("page_id", F.lit("old").alias("title"))
    changes = p.where("page_id % 2 = 0").select((F.col("page_id") % 60).alias("page_id"), F.concat(F.lit("v"), F.col("page_id").cast("string")).alias("title"), F.col("page_id").alias("seq"))
    return upserts.upsert(table, changes, ["page_id"], ["seq"])


@query("""
    WITH o AS (SELECT user_id AS id, min(ts) AS a, max(ts) AS b FROM events WHERE event_id % 2 = 0 GROUP BY 1),
    n AS (SELECT user_id AS id, min(ts) AS a, max(ts) AS b FROM events WHERE event_id % 2 = 1 GROUP BY 1)
    SELECT coalesce(o.id, n.id) AS id, strftime(coalesce(o.a, n.a), '%Y-%m-%d %H:%M:%S') AS first_load_time,
           strftime(greatest(o.b, n.b), '%Y-%m-%d %H:%M:%S') AS latest_activity_time
    FROM o FULL JOIN n ON o.id = n.id
""")
def upsert_tree_times(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    times = lambda k: e.where(F.col("event_id") % 2 == k).groupBy(F.col("user_id").alias("id")).agg(
        F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_load_time"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("latest_activity_time")
    )
    return upserts.upsert_trees(times(0), times(1))


# -------------------------------------------------------------------- markdown
DOC = "'# Log' || chr(10) || '## Pages' || chr(10) || chr(10) || '- one ' || page_id || chr(10) || '  - x' || chr(10) || chr(10) || '- two' || chr(10) || '## Next' || chr(10) || '- three' || chr(10)"


def _notes(spark, sf_dir):
    body = F.concat(F.lit("# Log\n## Pages\n\n- one "), F.col("page_id").cast("string"), F.lit("\n  - x\n\n- two\n## Next\n- three\n"))
    return tables.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), body.alias("text"))


@query("""
    SELECT page_id AS doc, 0 AS position, '- one ' || page_id || chr(10) || '  - x' AS block FROM pages
    UNION ALL SELECT page_id, 1, '- two' FROM pages
""")
def markdown_section_blocks(spark, sf_dir):
    return markdown.section_blocks(_notes(spark, sf_dir), "## Pages")


@query("""
    SELECT page_id AS doc, '## Pages' || chr(10) || chr(10) || CASE page_id % 3 WHEN 0 THEN '- new' || chr(10) || chr(10) || '- one ' || page_id || chr(10) || '  - x' || chr(10) || chr(10) || '- two'
           WHEN 1 THEN '- one ' || page_id || chr(10) || '  - y' || chr(10) || chr(10) || '- two' ELSE '- one ' || page_id || chr(10) || '  - x' END || chr(10) AS text FROM pages
""")
def markdown_block_edits(spark, sf_dir):
    blocks = markdown.section_blocks(_notes(spark, sf_dir), "## Pages")
    one = F.concat(F.lit("- one "), F.col("doc").cast("string"), F.lit("\n  - y"))
    changes = blocks.where("position = 0 AND doc % 3 < 2").select("doc", "position", F.when(F.col("doc") % 3 == 0, "- new").otherwise(one).alias("block"))
    gone = blocks.where("doc % 3 = 2 AND position = 1")
    return markdown.render_section(markdown.delete_blocks(markdown.upsert_blocks(blocks, changes), gone), "## Pages")


@query(f"""
    SELECT page_id, '- [' || CASE WHEN {TITLE} <> '' THEN {TITLE} ELSE {HOST} END || '](' || url || ') [2024-01-02 03:04]'
           || CASE WHEN {TEXT} <> '' THEN chr(10) || '  - Summary: ' || substr({TEXT}, 1, 200) ELSE '' END
           || chr(10) || CASE WHEN page_id % 3 = 0 THEN '  - Intentions: read; page ' || page_id ELSE '  - Intentions (new page): ' || replace({HOST}, '.', '; ') END AS block
    FROM pages
""")
def markdown_page_blocks(spark, sf_dir):
    a = tables.page_analysis(spark, sf_dir)
    of_tree = F.when(F.col("page_id") % 3 == 0, F.array(F.lit("read"), F.concat(F.lit("page "), F.col("page_id").cast("string"))))
    lines = markdown.block_lines(F.col("title"), F.col("url"), F.lit("2024-01-02T03:04:05Z"), F.lit(None).cast("string"), F.col("summary"), of_tree, F.col("intentions"))
    return a.select("page_id", F.array_join(lines, "\n").alias("block"))


# ----------------------------------------------------------------- SQL and API
@query("SELECT source, count(*) AS n FROM documents WHERE lang = 'en' AND n_chars >= 500 GROUP BY source")
def sql_interface(spark, sf_dir):
    store = api.Store(spark, sf_dir)
    return store.sql("SELECT source, count(*) AS n FROM documents WHERE lang = :lang AND n_chars >= :least GROUP BY source", {"lang": "en", "least": 500})


@query("SELECT p_brand, p_size, count(*) AS n, GROUPING(p_brand) + GROUPING(p_size) AS level FROM part GROUP BY ROLLUP (p_brand, p_size)")
def rollup_upgrade(spark, sf_dir):
    p = tables.table(spark, sf_dir, "part")
    return p.rollup("p_brand", "p_size").agg(F.count("*").alias("n"), (F.grouping("p_brand").cast("long") + F.grouping("p_size").cast("long")).alias("level"))


@query("""
    SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
""")
def tumbling_windows(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total"
    )


@query("""
    SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
           round(avg(l_discount), 9) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2
""")
def generic_aggregate(spark, sf_dir):
    li = tables.table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
        F.round(F.avg("l_discount"), 9).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("""
    SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
""")
def generic_join(spark, sf_dir):
    t = lambda n: tables.table(spark, sf_dir, n)
    per_customer = t("orders").groupBy("o_custkey").agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("s"))
    return (
        per_customer.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey").agg(F.sum("k").alias("orders"), F.round(F.sum("s"), 2).alias("total"))
        .join(t("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "orders", "total")
    )
