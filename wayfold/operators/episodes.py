"""Queries and corrections over episodic memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_words
from .order import numbered

# What each page type is called where no reason is stored.
TYPE_LABELS = {
    "knowledge": "Knowledge content",
    "interactive_app": "Web application",
    "aggregator": "Link aggregator",
    "leisure": "Entertainment content",
    "navigation": "Navigation page",
    "other": "Other content",
}


def recent(episodes: DataFrame, now: Column, hours: int, corrected: bool = False) -> DataFrame:
    """Episodes of the last `hours`, or corrections of that time; newest first is the caller's sort."""
    at = "correction_timestamp" if corrected else "timestamp"
    rows = episodes.where(F.col(at) >= now - F.make_dt_interval(hours=F.lit(hours)))
    return rows.where(F.col("correction_timestamp").isNotNull()) if corrected else rows


def newest_of_domain(episodes: DataFrame, limit: int = 50) -> DataFrame:
    """The newest episodes of each domain, with their rank."""
    w = Window.partitionBy("domain").orderBy(F.desc("timestamp"), F.desc("id"))
    return episodes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def similar_decisions(episodes: DataFrame, limit: int = 10) -> DataFrame:
    """The newest episodes of each domain, page type and decision, with their rank."""
    w = Window.partitionBy("domain", "page_type", "original_decision").orderBy(F.desc("timestamp"), F.desc("id"))
    return episodes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def correction_statistics(episodes: DataFrame) -> DataFrame:
    """One row: episodes, corrections, false positives and negatives, correction rate."""
    decided, fixed = F.col("original_decision"), F.col("correction_decision")
    total, corrected = F.count("*"), F.count("correction_timestamp")
    return episodes.agg(
        total.alias("total"), corrected.alias("corrected"),
        F.count_if(decided & (~fixed)).alias("false_positives"),
        F.count_if((~decided) & fixed).alias("false_negatives"),
        F.when(total > 0, corrected / total).otherwise(0.0).alias("correction_rate"),
    )


def corrections_by_type(episodes: DataFrame) -> DataFrame:
    """How often each type was the correction."""
    return episodes.where(F.col("correction_type").isNotNull()).groupBy("correction_type").agg(F.count("*").alias("n"))


def domain_errors(episodes: DataFrame) -> DataFrame:
    """Corrected episodes of each domain."""
    return episodes.where(F.col("correction_timestamp").isNotNull()).groupBy("domain").agg(F.count("*").alias("errors"))


def rule_suggestions(episodes: DataFrame, more_than: int = 3) -> DataFrame:
    """Domains whose errors with a written explanation call for a rule."""
    told = episodes.where(F.col("correction_explanation").isNotNull()).select("domain").distinct()
    return domain_errors(episodes).where(F.col("errors") > more_than).join(told, "domain", "left_semi")


def domain_majority(episodes: DataFrame) -> DataFrame:
    """Per domain the corrections among its 50 newest episodes, and the pattern they make.

    With three corrections or more, one side of more than twice the other is a pattern.
    """
    n = newest_of_domain(episodes, 50).where(F.col("correction_timestamp").isNotNull()).groupBy("domain").agg(
        F.count_if(F.col("correction_decision")).alias("accepted"), F.count("*").alias("corrected")
    )
    rejected = F.col("corrected") - F.col("accepted")
    few = F.col("corrected") < 3
    return n.withColumn(
        "pattern",
        F.when(few, "none").when(F.col("accepted") > 2 * rejected, "accept").when(rejected > 2 * F.col("accepted"), "reject").otherwise("none"),
    )


def decision_boost(episodes: DataFrame) -> DataFrame:
    """(domain, page_type, boost): accepted minus rejected over both, times 0.2; each side counts its 10 newest."""
    n = similar_decisions(episodes, 10).groupBy("domain", "page_type").agg(
        F.count_if(F.col("original_decision")).alias("accepted"), F.count_if(~F.col("original_decision")).alias("rejected")
    )
    a, r = F.col("accepted"), F.col("rejected")
    return n.withColumn("boost", F.when(a + r > 0, (a - r) / (a + r) * 0.2).otherwise(0.0))


def brief_reason() -> Column:
    """Why an episode ended as it did, in a few words."""
    label = F.create_map(*[F.lit(x) for kv in TYPE_LABELS.items() for x in kv])
    corrected = (
        F.when(F.coalesce("correction_explanation", F.lit("")) != "", F.concat(F.lit("Corrected: "), first_words(F.col("correction_explanation")), F.lit("...")))
        .when(F.coalesce("correction_type", F.lit("")) != "", F.concat(F.lit("Corrected to "), "correction_type"))
        .when(F.col("correction_decision"), "Corrected: should accept").otherwise("Corrected: should filter")
    )
    by_type = F.concat(F.coalesce(F.try_element_at(label, F.col("page_type")), F.col("page_type")), F.when(F.col("confidence") < 0.7, " (low conf)").otherwise(""))
    told = F.coalesce("reasoning", F.lit("")) != ""
    return F.when(told & F.col("correction_timestamp").isNotNull(), corrected).when(told, F.col("reasoning")).otherwise(by_type)


def apply_corrections(episodes: DataFrame, corrections: DataFrame) -> DataFrame:
    """Episodes with the latest correction of each (id, decision, type, explanation, at) in place.

    All four correction columns are overwritten, those that the correction leaves out with null.
    """
    last = corrections.groupBy("id").agg(F.max_by(F.struct("decision", "type", "explanation", "at"), "at").alias("_c"))
    hit = F.col("_c").isNotNull()
    pairs = {"correction_decision": "decision", "correction_type": "type", "correction_explanation": "explanation", "correction_timestamp": "at"}
    return episodes.join(last, "id", "left").withColumns({k: F.when(hit, F.col(f"_c.{v}")).otherwise(F.col(k)) for k, v in pairs.items()}).drop("_c")


def feedback_corrections(episodes: DataFrame, feedback: DataFrame) -> DataFrame:
    """Corrections from (url, was_correct, type, explanation, at): the URL's newest episode, decision reversed.

    Correct feedback changes nothing; without a type the episode keeps its own.
    """
    newest = episodes.groupBy("url").agg(F.max_by(F.struct("id", "original_decision", "page_type"), F.struct("timestamp", "id")).alias("e"))
    return feedback.where(~F.col("was_correct")).join(newest, "url").select(
        "e.id", (~F.col("e.original_decision")).alias("decision"), F.coalesce("type", "e.page_type").alias("type"), "explanation", "at"
    )


def review_document(rows: DataFrame, now: Column, recent_days: int = 7, filtered_hours: int = 48) -> DataFrame:
    """(section, position, line): the review of decisions, a row a line, in the order of section and position.

    Section 0 is the head with the statistics of all episodes, 1 the accepted pages of the last days, 2 the filtered ones of the
    last hours, each newest first with its reason, 3 the legend. A section without pages says so. Pages are numbered
    a day at a time, so nothing of a section's size meets in one task; a page is three lines.
    """
    corrected = F.col("correction_timestamp").isNotNull()
    said = rows.withColumns({"mark": F.when(corrected, F.lit(" ⚠️")).otherwise(""), "reason": brief_reason()})
    link = F.concat(F.lit("["), F.coalesce("title", F.lit("")), F.lit("]("), F.col("url"), F.lit(")"))
    parts = []
    windows = ((1, F.col("original_decision"), recent_days * 24, F.concat(F.lit("- "), link, "mark")), (2, ~F.col("original_decision"), filtered_hours, F.concat(F.lit("- ~~"), link, F.lit("~~"), "mark")))
    titles = {1: ("## Recent webpages", "accepted", f"{recent_days} days"), 2: ("## Filtered out webpages", "filtered", f"{filtered_hours} hours")}
    spark = rows.sparkSession
    for section, wanted, hours, head in windows:
        pages = recent(said.where(wanted), now, hours).select("timestamp", "id", head.alias("head"), F.concat(F.lit("  "), "reason").alias("why"))
        placed = numbered(pages.withColumn("_all", F.lit(0)), ["_all"], F.to_date("timestamp"), [F.desc("timestamp"), F.asc("id")], descending=True)
        lines = F.array(F.col("head"), F.col("why"), F.lit(""))
        parts.append(placed.select(F.lit(section).alias("section"), "position", F.posexplode(lines).alias("i", "line")).select("section", (4 + 3 * F.col("position") + F.col("i")).alias("position"), "line"))
        name, kind, span = titles[section]
        some = pages.agg(F.count("*").alias("n"))
        text = F.when(F.col("n") > 0, f"*{kind.capitalize()} pages from the last {span}*").otherwise(f"*No {kind} pages in the last {span}*")
        lines = F.array(F.lit(name), F.lit(""), text, F.lit(""))
        parts.append(some.select(F.lit(section).alias("section"), F.posexplode(lines).alias("position", "line")).withColumn("position", F.col("position").cast("long")))
    rate = F.when(F.col("n") > 0, F.col("c") / F.col("n") * 100).otherwise(F.lit(0.0))
    stats = F.concat(F.lit("Stats: "), F.col("n").cast("string"), F.lit(" total pages | "), F.col("c").cast("string"), F.lit(" corrections | "), F.format_string("%.1f", rate), F.lit("% correction rate"))
    made = F.concat(F.lit("> Generated: "), F.date_format(now, "yyyy-MM-dd HH:mm:ss"))
    head = rows.agg(F.count("*").alias("n"), F.count("correction_timestamp").alias("c")).select(F.posexplode(F.array(F.lit("# Webpage Review"), F.lit(""), made, F.lit(""), stats, F.lit(""))).alias("position", "line"))
    parts.append(head.select(F.lit(0).alias("section"), F.col("position").cast("long").alias("position"), "line"))
    legend = ["", "---", "", "**Legend**: ⚠️ = User corrected", "", f"*Recent pages are shown for {recent_days} days, filtered pages for {filtered_hours} hours*"]
    parts.append(spark.createDataFrame([(3, i, x) for i, x in enumerate(legend)], "section int, position long, line string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def written(document: DataFrame, path: str) -> None:
    """Write the lines of a review as text files whose names, and lines inside them, are in its order."""
    document.repartitionByRange("section", "position").sortWithinPartitions("section", "position").select(F.col("line").alias("value")).write.mode("overwrite").text(path)
