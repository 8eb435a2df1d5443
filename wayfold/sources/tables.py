"""Parquet tables and the views derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import html, url

# The page types of a classification.
PAGE_TYPES = ("knowledge", "interactive_app", "aggregator", "leisure", "navigation", "other")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page visits read off the event stream: a user is a tab, a signup starts afresh."""
    e = table(spark, sf_dir, "events")
    seen = e.select(
        "event_id", "event_type", F.col("user_id").alias("tab_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("https://"), "event_type", F.lit(".example.com/"), F.get_json_object("props", "$.k")).alias("url"),
    )
    last = F.lag("url").over(Window.partitionBy("tab_id").orderBy("ts", "event_id"))
    # the long texts are made of the others once those have been moved
    return (
        seen.withColumn("referrer", F.when(F.col("event_type") != "signup", last))
        .withColumn("page_loaded_at", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .withColumn("id", url.page_id(F.col("url"), F.col("page_loaded_at")))
    )


def page_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    f = html.features(F.col("html"), F.col("url"))
    return p.select("page_id", "url", url.host(F.col("url")).alias("domain"), f.alias("f")).select("page_id", "url", "domain", "f.*")


def page_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, a summary of 200 characters, and intentions from the host's labels."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        "page_id", "url", html.title(F.col("html"), F.col("url")).alias("title"),
        F.substring(html.text(F.col("html")), 1, 200).alias("summary"),
        F.split(url.host(F.col("url")), r"\.").alias("intentions"),
    )


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification episodes with user corrections, from documents and their labels."""
    d = table(spark, sf_dir, "documents").alias("d")
    lab = table(spark, sf_dir, "labels").alias("l")
    types = F.array(*[F.lit(t) for t in PAGE_TYPES])
    quality = F.col("l.quality")
    return d.join(lab, F.col("d.doc_id") == F.col("l.doc_id"), "left").select(
        F.col("d.doc_id").alias("id"),
        F.concat(F.lit("https://"), "d.source", F.lit(".example.com/"), F.col("d.doc_id").cast("string")).alias("url"),
        F.col("d.source").alias("domain"),
        F.element_at(types, (F.col("d.doc_id") % 6 + 1).cast("int")).alias("page_type"),
        ((F.col("d.doc_id") * 37 % 100) / 100).alias("confidence"),
        (F.col("d.doc_id") % 3 != 0).alias("original_decision"),
        F.when(F.col("d.doc_id") % 4 != 0, F.concat(F.lit("Because of "), "d.lang")).otherwise(F.lit("")).alias("reasoning"),
        (quality == 1).alias("correction_decision"),
        F.when(quality == 1, "knowledge").alias("correction_type"),
        F.when((quality.isNotNull()) & (F.col("d.doc_id") % 5 == 0), "a long user explanation that goes on for more words").alias("correction_explanation"),
        F.when(quality.isNotNull(), F.timestamp_add("MINUTE", F.col("d.doc_id").cast("int"), F.lit("2024-02-01 00:00:00").cast("timestamp"))).alias("correction_timestamp"),
        F.timestamp_add("MINUTE", F.col("d.doc_id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("timestamp"),
        F.substring("d.text", 1, 40).alias("title"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vector"), "label"
    )
