"""Filter decisions over classifications, memory adjustments and their metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clamp, percent


@dataclass(frozen=True)
class FilterConfig:
    enabled: bool = True
    allowed_types: Sequence[str] = ("knowledge",)
    min_confidence: float = 0.7


def heuristic_type(words: Column, density: Column, code: Column) -> Column:
    """An offline stand-in for a model: a page type from text features."""
    return (
        F.when(code, "knowledge").when(words < 20, "navigation").when(density > 0.2, "aggregator")
        .when(words < 60, "interactive_app").when(words > 150, "knowledge").otherwise("other")
    )


def should_process(page_type: Column, confidence: Column, model: Column, config: FilterConfig) -> Column:
    """Type allowed, confidence high enough, and the model agrees; true when filtering is off."""
    if not config.enabled:
        return F.lit(True)
    return page_type.isin(*config.allowed_types) & (confidence >= config.min_confidence) & model


def filter_reason(page_type: Column, confidence: Column, model: Column, config: FilterConfig) -> Column:
    """Why a page is filtered; null if it is processed."""
    return F.when(
        ~should_process(page_type, confidence, model, config),
        F.when(~page_type.isin(*config.allowed_types), "type_not_allowed")
        .when(confidence < config.min_confidence, "low_confidence").otherwise("model_recommendation"),
    )


def memory_adjusted(pages: DataFrame, similar: DataFrame, patterns: DataFrame, config: FilterConfig) -> DataFrame:
    """Adjust classifications by the corrections of similar episodes and of the domain.

    `pages` has id, domain, page_type, confidence, model; `similar` has page_id, rank and
    the episode's original_decision, correction_decision and correction_type; `patterns` is
    a domain and its pattern. Every correction that reverses its episode and contradicts
    the page costs 0.05; two corrections alike override the decision; the
    last corrected type by rank wins; a domain pattern moves confidence by 0.2 and overrides a
    contrary decision.
    """
    c = similar.where(F.col("correction_decision").isNotNull()).join(pages.select(F.col("id").alias("page_id"), F.col("model").alias("_model")), "page_id")
    against = (F.col("correction_decision") != F.col("original_decision")) & (F.col("correction_decision") != F.col("_model"))
    per_page = c.groupBy("page_id").agg(
        F.count("*").alias("influences"), F.count_if(against).alias("_against"),
        F.count_if(F.col("correction_decision") != F.col("_model")).alias("_contrary"),
        F.max_by("correction_type", F.when(F.col("correction_type").isNotNull(), F.col("rank"))).alias("_type"),
    )
    joined = pages.join(per_page.withColumnRenamed("page_id", "id"), "id", "left").join(patterns.select("domain", "pattern"), "domain", "left")
    step = F.when(F.col("pattern") == "accept", 0.2).when(F.col("pattern") == "reject", -0.2).otherwise(0.0)
    by_domain = F.when((F.col("pattern") == "accept") & ~F.col("model"), True).when((F.col("pattern") == "reject") & F.col("model"), False)
    by_similar = F.when((F.col("_against") > 0) & (F.col("_contrary") >= 2), ~F.col("model"))
    new_type, new_confidence = F.coalesce("_type", "page_type"), clamp(F.col("confidence") + F.col("adjustment"))
    return (
        joined.withColumns({
            "adjustment": F.coalesce("_against", F.lit(0)) * F.lit(-0.05) + step,
            "override": F.coalesce(by_domain, by_similar),
        })
        .withColumns({"adjusted_type": new_type, "adjusted_confidence": new_confidence, "influences": F.coalesce("influences", F.lit(0))})
        .withColumn("decision", F.coalesce("override", should_process(F.col("adjusted_type"), F.col("adjusted_confidence"), F.col("model"), config)))
        .drop("_against", "_contrary", "_type", "pattern")
    )


def second_gate(adjusted: DataFrame, config: FilterConfig) -> DataFrame:
    """`memory_adjusted` pages with `processed`: the adjusted type and confidence are held to the filter again, overrides too."""
    return adjusted.withColumn(
        "processed", should_process(F.col("adjusted_type"), F.col("adjusted_confidence"), F.coalesce("override", "model"), config)
    )


def enhanced_decision(page_type: Column, confidence: Column, model: Column, outcome: Column, boosts: Column, boost: Column, config: FilterConfig) -> Column:
    """A struct of decision, confidence and reason from rules first, then memory.

    `outcome` is the terminal rule's kind or null, `boosts` how many priority boosts came
    before it, `boost` the episodic one. Without a terminal rule the boosted confidence and
    the type decide, whatever the model said.
    """
    raised = F.least(F.lit(1.0), confidence + 0.1 * boosts)
    final = F.when(outcome.isNull(), clamp(raised + boost)).otherwise(raised)
    allowed, sure = page_type.isin(*config.allowed_types), final >= config.min_confidence
    free = F.when(F.lit(not config.enabled), model).otherwise(allowed & sure)
    reason = (
        F.when(outcome == "reject", "rule_reject").when(outcome == "accept", "rule_accept").when(F.lit(not config.enabled), "disabled")
        .when(~allowed, "type_not_allowed").when(~sure, "low_confidence").otherwise("accepted")
    )
    return F.struct(F.when(outcome == "reject", False).when(outcome == "accept", True).otherwise(free).alias("decision"), final.alias("confidence"), reason.alias("reason"))


def filter_metrics(decided: DataFrame) -> DataFrame:
    """One row over (page_type, confidence, decision): totals and average confidence."""
    return decided.agg(
        F.count("*").alias("total"), F.count_if("decision").alias("processed"), F.count_if(~F.col("decision")).alias("filtered"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("average_confidence"),
    )


def metric_shares(decided: DataFrame) -> DataFrame:
    """(kind, name, n, percent): page types as shares of all, reasons as shares of the filtered."""
    kinds = decided.select(F.explode(F.array(
        F.struct(F.lit("type").alias("kind"), F.col("page_type").alias("name")),
        F.struct(F.when(F.col("reason").isNotNull(), "reason").alias("kind"), F.col("reason").alias("name")),
    )).alias("x")).where("x.kind IS NOT NULL").groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))
    totals = kinds.groupBy("kind").agg(F.sum("n").alias("_total"))
    return kinds.join(totals, "kind").select("kind", "name", "n", percent(F.col("n"), F.col("_total")).alias("percent"))


def confusion(pairs: DataFrame) -> DataFrame:
    """(actual, predicted, n)."""
    return pairs.groupBy("actual", "predicted").agg(F.count("*").alias("n"))


def f1_scores(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class, from one aggregation."""
    c = confusion(pairs)
    sides = c.select(F.explode(F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("a"), F.lit(0).cast("long").alias("p")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("a"), F.col("n").alias("p")),
    )).alias("x"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"))
    g = sides.groupBy("x.label").agg(F.sum("x.a").alias("support"), F.sum("x.p").alias("predicted"), (F.sum("hit") / 2).alias("hits"))
    p = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    return g.withColumns({"precision": p, "recall": r}).withColumn(
        "f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    ).select("label", "support", "precision", "recall", "f1")
