"""Sections and blocks of markdown documents.

A block is a run of non-blank lines below a section's heading; a section ends at the next
second-level heading. Documents are rows (doc, text); blocks are rows (doc, position, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import minute


def block_lines(
    title: Column, url: Column, loaded_at: Column, referrer: Column, summary: Column, tree_intentions: Column, intentions: Column
) -> Column:
    """The lines of a page's block; the page's own intentions stand in where the tree has none."""
    given = lambda x: F.nullif(x, F.lit(""))
    head = F.concat(F.lit("- ["), F.coalesce(given(title), F.lit("Untitled")), F.lit("]("), url, F.lit(") ["), minute(loaded_at), F.lit("]"))
    lines = F.array(
        head, F.concat(F.lit("  - Referrer: "), given(referrer)), F.concat(F.lit("  - Summary: "), given(summary)),
        intention_line(tree_intentions, intentions, "  "),
    )
    return F.filter(lines, lambda x: x.isNotNull())


def intention_line(tree_intentions: Column, intentions: Column, indent: str) -> Column:
    """The line of the tree's intentions, else that of a new page's; null without either."""
    line = lambda name, x: F.concat(F.lit(f"{indent}- {name}: "), F.array_join(x, "; "))
    return F.coalesce(line("Intentions", tree_intentions), line("Intentions (new page)", intentions))


def section_blocks(docs: DataFrame, heading: str) -> DataFrame:
    """(doc, position, block) of a section; a document without the heading has no rows."""
    body = F.concat(F.lit("\n"), "text", F.lit("\n"))
    escaped = "".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in heading)
    section = F.regexp_extract(body, rf"(?s)\n{escaped}\n(.*?)(?=\n## |\z)", 1)
    blocks = F.filter(F.split(section, r"\n[ \t]*(?:\n[ \t]*)*\n|^\s*\n"), lambda b: F.trim(F.regexp_replace(b, r"\s+", "")) != "")
    trimmed = F.transform(blocks, lambda b: F.regexp_replace(b, r"^\n+|\n+$", ""))
    return docs.select("doc", F.posexplode(trimmed).alias("position", "block"))


def first_line(block: Column) -> Column:
    """What identifies a block."""
    return F.split_part(block, F.lit("\n"), F.lit(1))


def upsert_blocks(blocks: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace blocks with the same first line in place; put the others in front, in their order.

    (doc, position, block) in both; positions are renumbered from 0.
    """
    keyed = changes.select("doc", first_line(F.col("block")).alias("_k"), F.col("block").alias("_new"), F.col("position").alias("_at"))
    merged = blocks.withColumn("_k", first_line(F.col("block"))).join(keyed, ["doc", "_k"], "full")
    rank = F.struct(F.col("position").isNotNull().alias("old"), F.coalesce("position", "_at").alias("at"), "_k")
    w = Window.partitionBy("doc").orderBy(rank)
    return merged.select("doc", (F.row_number().over(w) - 1).alias("position"), F.coalesce("_new", "block").alias("block"))


def delete_blocks(blocks: DataFrame, gone: DataFrame) -> DataFrame:
    """Blocks without those that equal a given whole block."""
    return blocks.join(gone.select("doc", "block"), ["doc", "block"], "left_anti")


def render_section(blocks: DataFrame, heading: str) -> DataFrame:
    """(doc, text): the heading and the blocks, a blank line between any two."""
    ordered = F.sort_array(F.collect_list(F.struct("position", "block")))
    return blocks.groupBy("doc").agg(ordered.alias("b")).select(
        "doc", F.concat(F.lit(heading + "\n\n"), F.array_join("b.block", "\n\n"), F.lit("\n")).alias("text")
    )
