"""Markdown notes from a folder tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import join_list, note_description, note_sections


def read_notes(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """All .md files below `root`, newest first: name, path, sections, description, body, updated_at."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
        .select("path", F.col("modificationTime").alias("updated_at"), F.decode("content", "utf-8").alias("body"))
    )
    if limit is not None:
        files = files.orderBy(F.desc("updated_at"), "path").limit(limit)
    return files.select(
        F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("name"), "path", note_sections(F.col("body")).alias("sections"),
        note_description(F.col("body")).alias("description"), "body", "updated_at",
    )


def note_table(notes: DataFrame) -> DataFrame:
    """What the note namespace stores: the body cut to 1000 characters, sections as one text."""
    return notes.select(
        F.col("path").alias("key"), "name", join_list(F.col("sections")).alias("sections_string"), "description",
        F.substring("body", 1, 1000).alias("body"), "updated_at",
    )
