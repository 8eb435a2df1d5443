"""Episodic memory, decisions and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions, episodes, order
from ..sources import tables
from .registry import query

CONFIG = decisions.FilterConfig()
NOW = "2024-01-01 12:00:00"
EPISODES = """
    episodes AS (
        SELECT d.doc_id AS id, 'https://' || d.source || '.example.com/' || d.doc_id AS url, d.source AS domain,
               list_extract(['knowledge', 'interactive_app', 'aggregator', 'leisure', 'navigation', 'other'], d.doc_id % 6 + 1) AS page_type,
               (d.doc_id * 37 % 100) / 100 AS confidence, d.doc_id % 3 <> 0 AS original_decision,
               CASE WHEN d.doc_id % 4 <> 0 THEN 'Because of ' || d.lang ELSE '' END AS reasoning,
               l.quality = 1 AS correction_decision, CASE WHEN l.quality = 1 THEN 'knowledge' END AS correction_type,
               CASE WHEN l.quality IS NOT NULL AND d.doc_id % 5 = 0 THEN 'a long user explanation that goes on for more words' END AS correction_explanation,
               CASE WHEN l.quality IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' + to_minutes(d.doc_id) END AS correction_timestamp,
               TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id) AS timestamp, substr(d.text, 1, 40) AS title
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    )
"""


def _now():
    return F.lit(NOW).cast("timestamp")


@query(f"""
    WITH {EPISODES} SELECT id, domain, page_type FROM episodes WHERE timestamp >= TIMESTAMP '{NOW}' - INTERVAL 5 HOURS
""")
def episodes_recent(spark, sf_dir):
    return episodes.recent(tables.episodes(spark, sf_dir), _now(), 5).select("id", "domain", "page_type")


@query(f"""
    WITH {EPISODES}, r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY timestamp DESC, id DESC) AS n FROM episodes)
    SELECT domain, id, CAST(n AS INTEGER) AS rank FROM r WHERE n <= 50
""")
def episodes_by_domain_top50(spark, sf_dir):
    return episodes.newest_of_domain(tables.episodes(spark, sf_dir), 50).select("domain", "id", "rank")


@query(f"""
    WITH {EPISODES}, r AS (
        SELECT *, row_number() OVER (PARTITION BY domain, page_type, original_decision ORDER BY timestamp DESC, id DESC) AS n FROM episodes)
    SELECT domain, page_type, original_decision, id, CAST(n AS INTEGER) AS rank FROM r WHERE n <= 10
""")
def similar_decisions_top10(spark, sf_dir):
    return episodes.similar_decisions(tables.episodes(spark, sf_dir)).select("domain", "page_type", "original_decision", "id", "rank")


@query(f"""
    WITH {EPISODES}
    SELECT count(*) AS total, count(correction_timestamp) AS corrected,
           count(*) FILTER (WHERE original_decision AND NOT correction_decision) AS false_positives,
           count(*) FILTER (WHERE NOT original_decision AND correction_decision) AS false_negatives,
           round(count(correction_timestamp) / count(*), 9) AS correction_rate FROM episodes
""")
def correction_stats(spark, sf_dir):
    s = episodes.correction_statistics(tables.episodes(spark, sf_dir))
    return s.withColumn("correction_rate", F.round("correction_rate", 9))


@query(f"WITH {EPISODES} SELECT correction_type, count(*) AS n FROM episodes WHERE correction_type IS NOT NULL GROUP BY 1")
def corrections_by_type(spark, sf_dir):
    return episodes.corrections_by_type(tables.episodes(spark, sf_dir))


@query(f"WITH {EPISODES} SELECT domain, count(*) AS errors FROM episodes WHERE correction_timestamp IS NOT NULL GROUP BY 1")
def domain_error_count(spark, sf_dir):
    return episodes.domain_errors(tables.episodes(spark, sf_dir))


@query(f"""
    WITH {EPISODES} SELECT domain, count(correction_timestamp) AS errors FROM episodes GROUP BY 1
    HAVING count(correction_timestamp) > 3 AND count(correction_explanation) > 0
""")
def rule_suggestions(spark, sf_dir):
    return episodes.rule_suggestions(tables.episodes(spark, sf_dir))


PATTERNS = f"""
    {EPISODES}, newest AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY timestamp DESC, id DESC) AS n FROM episodes),
    counts AS (
        SELECT domain, count(*) FILTER (WHERE correction_decision) AS accepted, count(*) AS corrected
        FROM newest WHERE n <= 50 AND correction_timestamp IS NOT NULL GROUP BY domain
    ), patterns AS (
        SELECT *, CASE WHEN corrected < 3 THEN 'none' WHEN accepted > 2 * (corrected - accepted) THEN 'accept'
                       WHEN corrected - accepted > 2 * accepted THEN 'reject' ELSE 'none' END AS pattern FROM counts
    )
"""


@query(f"WITH {PATTERNS} SELECT domain, accepted, corrected, pattern FROM patterns")
def domain_majority(spark, sf_dir):
    return episodes.domain_majority(tables.episodes(spark, sf_dir)).select("domain", "accepted", "corrected", "pattern")


BOOSTS = f"""
    {EPISODES}, ranked AS (
        SELECT *, row_number() OVER (PARTITION BY domain, page_type, original_decision ORDER BY timestamp DESC, id DESC) AS n FROM episodes),
    sides AS (
        SELECT domain, page_type, count(*) FILTER (WHERE original_decision) AS accepted, count(*) FILTER (WHERE NOT original_decision) AS rejected
        FROM ranked WHERE n <= 10 GROUP BY domain, page_type
    ), boosts AS (SELECT *, (accepted - rejected) / (accepted + rejected) * 0.2 AS boost FROM sides)
"""


@query(f"WITH {BOOSTS} SELECT domain, page_type, accepted, rejected, round(boost, 9) AS boost FROM boosts")
def episodic_boost(spark, sf_dir):
    return episodes.decision_boost(tables.episodes(spark, sf_dir)).withColumn("boost", F.round("boost", 9))


@query(f"""
    WITH {PATTERNS}, alike AS (
        SELECT p.id AS page_id, p.original_decision AS model, e.original_decision, e.correction_decision, e.correction_type,
               row_number() OVER (PARTITION BY p.id ORDER BY e.timestamp DESC, e.id DESC) AS rank
        FROM episodes p JOIN episodes e ON p.domain = e.domain AND p.page_type = e.page_type AND e.timestamp < p.timestamp
    ), c AS (
        SELECT page_id, count(*) AS influences,
               count(*) FILTER (WHERE correction_decision <> original_decision AND correction_decision <> model) AS against,
               count(*) FILTER (WHERE correction_decision <> model) AS contrary, arg_max(correction_type, rank) FILTER (WHERE correction_type IS NOT NULL) AS ctype
        FROM alike WHERE rank <= 5 AND correction_decision IS NOT NULL GROUP BY page_id
    ), j AS (
        SELECT e.*, coalesce(c.influences, 0) AS influences, c.against, c.contrary, c.ctype,
               coalesce(c.against, 0) * -0.05 + CASE p.pattern WHEN 'accept' THEN 0.2 WHEN 'reject' THEN -0.2 ELSE 0 END AS adjustment, p.pattern
        FROM episodes e LEFT JOIN c ON e.id = c.page_id LEFT JOIN patterns p ON e.domain = p.domain
    ), k AS (
        SELECT *, coalesce(ctype, page_type) AS adjusted_type, greatest(0, least(1, confidence + CAST(adjustment AS DOUBLE))) AS adjusted_confidence,
               coalesce(CASE WHEN pattern = 'accept' AND NOT original_decision THEN true WHEN pattern = 'reject' AND original_decision THEN false END,
                        CASE WHEN against > 0 AND contrary >= 2 THEN NOT original_decision END) AS override FROM j
    )
    SELECT id, adjusted_type, round(adjusted_confidence, 6) AS adjusted_confidence, influences,
           coalesce(override, adjusted_type = 'knowledge' AND round(adjusted_confidence, 6) >= 0.7 AND original_decision) AS decision FROM k
""")
def memory_adjust(spark, sf_dir):
    e = tables.episodes(spark, sf_dir)
    pages = e.select("id", "domain", "page_type", "confidence", F.col("original_decision").alias("model"))
    m = decisions.memory_adjusted(pages, _similar(e, 5), episodes.domain_majority(e), CONFIG)
    rounded = F.round("adjusted_confidence", 6)
    decision = F.coalesce("override", decisions.should_process(F.col("adjusted_type"), rounded, F.col("model"), CONFIG))
    return m.select("id", "adjusted_type", rounded.alias("adjusted_confidence"), "influences", decision.alias("decision"))


def _similar(e, limit):
    """For each episode the `limit` earlier ones next to it of its domain and type, by their places in time."""
    narrow = e.select(F.col("id").alias("page_id"), "domain", "page_type", "timestamp", "original_decision", "correction_decision", "correction_type")
    said = ["original_decision", "correction_decision", "correction_type"]
    return order.preceding(narrow, ["domain", "page_type"], F.to_date("timestamp"), [F.asc("timestamp"), F.asc("page_id")], limit, "page_id", said)


@query(f"""
    WITH {EPISODES}
    SELECT id, page_type = 'knowledge' AND confidence >= 0.7 AND original_decision AS decision,
           CASE WHEN page_type = 'knowledge' AND confidence >= 0.7 AND original_decision THEN NULL
                WHEN page_type <> 'knowledge' THEN 'type_not_allowed' WHEN confidence < 0.7 THEN 'low_confidence' ELSE 'model_recommendation' END AS reason
    FROM episodes
""")
def filter_decision(spark, sf_dir):
    return _decided(spark, sf_dir).select("id", "decision", "reason")


def _decided(spark, sf_dir):
    args = (F.col("page_type"), F.col("confidence"), F.col("original_decision"), CONFIG)
    return tables.episodes(spark, sf_dir).withColumns({"decision": decisions.should_process(*args), "reason": decisions.filter_reason(*args)})


@query(f"""
    WITH {EPISODES}, d AS (SELECT *, page_type = 'knowledge' AND confidence >= 0.7 AND original_decision AS decision FROM episodes)
    SELECT count(*) AS total, count(*) FILTER (WHERE decision) AS processed, count(*) FILTER (WHERE NOT decision) AS filtered,
           round(avg(confidence), 9) AS average_confidence FROM d
""")
def filter_metrics(spark, sf_dir):
    return decisions.filter_metrics(_decided(spark, sf_dir)).withColumn("average_confidence", F.round("average_confidence", 9))


@query(f"""
    WITH {EPISODES}, d AS (
        SELECT page_type, CASE WHEN page_type = 'knowledge' AND confidence >= 0.7 AND original_decision THEN NULL
                WHEN page_type <> 'knowledge' THEN 'type_not_allowed' WHEN confidence < 0.7 THEN 'low_confidence' ELSE 'model_recommendation' END AS reason
        FROM episodes
    ), k AS (
        SELECT 'type' AS kind, page_type AS name, count(*) AS n FROM d GROUP BY 2
        UNION ALL SELECT 'reason', reason, count(*) FROM d WHERE reason IS NOT NULL GROUP BY 2
    )
    SELECT kind, name, n, round(100.0 * n / CAST(sum(n) OVER (PARTITION BY kind) AS DOUBLE), 1) AS percent FROM k
""")
def filter_metric_pct(spark, sf_dir):
    return decisions.metric_shares(_decided(spark, sf_dir))


REASON = """
    CASE WHEN reasoning <> '' AND correction_timestamp IS NOT NULL THEN
             CASE WHEN coalesce(correction_explanation, '') <> '' THEN 'Corrected: ' || array_to_string(string_split(correction_explanation, ' ')[1:8], ' ') || '...'
                  WHEN coalesce(correction_type, '') <> '' THEN 'Corrected to ' || correction_type
                  WHEN correction_decision THEN 'Corrected: should accept' ELSE 'Corrected: should filter' END
         WHEN reasoning <> '' THEN reasoning
         ELSE CASE page_type WHEN 'knowledge' THEN 'Knowledge content' WHEN 'interactive_app' THEN 'Web application' WHEN 'aggregator' THEN 'Link aggregator'
                   WHEN 'leisure' THEN 'Entertainment content' WHEN 'navigation' THEN 'Navigation page' WHEN 'other' THEN 'Other content' ELSE page_type END
              || CASE WHEN confidence < 0.7 THEN ' (low conf)' ELSE '' END END
"""


@query(f"WITH {EPISODES} SELECT id, {REASON} AS reason FROM episodes")
def brief_reason(spark, sf_dir):
    return tables.episodes(spark, sf_dir).select("id", episodes.brief_reason().alias("reason"))


@query(f"""
    WITH {EPISODES}
    SELECT id, CASE WHEN original_decision THEN 'accepted' ELSE 'filtered' END AS section,
           '- [' || title || '](' || url || ') ' || {REASON} AS line
    FROM episodes WHERE timestamp >= TIMESTAMP '{NOW}' - INTERVAL 48 HOURS
""")
def review_report(spark, sf_dir):
    line = F.concat(F.lit("- ["), "title", F.lit("]("), "url", F.lit(") "), episodes.brief_reason())
    return episodes.recent(tables.episodes(spark, sf_dir), _now(), 48).select(
        "id", F.when(F.col("original_decision"), "accepted").otherwise("filtered").alias("section"), line.alias("line")
    )


@query(f"""
    WITH {EPISODES}, f AS (
        SELECT id, NOT original_decision AS decision, page_type AS ctype FROM episodes WHERE id % 11 = 0 AND id % 2 = 0
    )
    SELECT e.id, CASE WHEN f.id IS NULL THEN e.correction_decision ELSE f.decision END AS correction_decision,
           CASE WHEN f.id IS NULL THEN e.correction_type ELSE f.ctype END AS correction_type,
           CASE WHEN f.id IS NULL THEN e.correction_explanation ELSE 'feedback ' || e.id END AS correction_explanation
    FROM episodes e LEFT JOIN f ON e.id = f.id
""")
def correction_apply(spark, sf_dir):
    e = tables.episodes(spark, sf_dir)
    feedback = e.where("id % 11 = 0").select(
        "url", (F.col("id") % 2 == 1).alias("was_correct"), F.lit(None).cast("string").alias("type"),
        F.concat(F.lit("feedback "), F.col("id").cast("string")).alias("explanation"), F.lit("2024-03-01 00:00:00").cast("timestamp").alias("at"),
    )
    fixed = episodes.apply_corrections(e, episodes.feedback_corrections(e, feedback))
    return fixed.select("id", "correction_decision", "correction_type", "correction_explanation")


PAIRS = "pairs AS (SELECT l.quality AS actual, CASE WHEN d.n_chars % 10 < 8 THEN 1 ELSE 0 END AS predicted FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def _pairs(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") % 10 < 8, 1).otherwise(0).alias("predicted"))
    return tables.table(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("quality").alias("actual"), "predicted")


@query(f"WITH {PAIRS} SELECT actual, predicted, count(*) AS n FROM pairs GROUP BY 1, 2")
def eval_confusion(spark, sf_dir):
    return decisions.confusion(_pairs(spark, sf_dir))


@query(f"""
    WITH {PAIRS}, l AS (SELECT DISTINCT actual AS label FROM pairs UNION SELECT predicted FROM pairs), c AS (
        SELECT label, (SELECT count(*) FROM pairs WHERE actual = label) AS support, (SELECT count(*) FROM pairs WHERE predicted = label) AS predicted,
               (SELECT count(*) FROM pairs WHERE predicted = label AND actual = label) AS hits FROM l
    ), s AS (SELECT label, support, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS r FROM c)
    SELECT label, support, round(p, 9) AS "precision", round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM s
""")
def eval_f1(spark, sf_dir):
    return decisions.f1_scores(_pairs(spark, sf_dir)).select("label", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])
