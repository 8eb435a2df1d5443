"""Edits of a section of whole markdown documents, all other lines kept as they are.

A document is a row (doc, text). Everything is column functions over the document's array of lines, so an edit is one pass
without a shuffle but for the edits themselves, which are brought together by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How a block begins in a section of notes, and the lines between a heading and its section.
BLOCK_START = "- ["
HEAD_LINES = 2
KINDS = ("insert", "upsert", "delete")
_STATE = "struct<blocks:array<string>,now:string,inside:boolean>"


def _trim(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def bounds(lines: Column, heading: str) -> Column:
    """Struct of start and end (positions of lines from 0, end excluded) of a section; null if no line is the heading.

    A section starts two lines after its heading and ends at the next second-level heading of another name.
    """
    at = F.array_position(F.transform(lines, _trim), heading)
    start = (at - 1 + HEAD_LINES).cast("int")
    other = lambda line: _trim(line).rlike(r"^##\s") & (_trim(line) != heading)
    ends = F.filter(F.transform(lines, lambda line, i: F.when((i >= start) & other(line), i)), lambda i: i.isNotNull())
    return F.when(at > 0, F.struct(start.alias("start"), F.coalesce(F.array_min(ends), F.greatest(start, F.size(lines))).cast("int").alias("end")))


def blocks_of(lines: Column, begins: str = BLOCK_START) -> Column:
    """The blocks among lines, each as its text: from a line that begins so up to the next one or a blank line."""
    blank = lambda line: _trim(line) == ""
    put = lambda s: F.when(s["now"].isNull(), s["blocks"]).otherwise(F.concat(s["blocks"], F.array(s["now"])))

    def step(s: Column, line: Column) -> Column:
        opens = F.startswith(line, F.lit(begins))
        joined = F.when(s["now"].isNull(), line).otherwise(F.concat(s["now"], F.lit("\n"), line))
        inside = opens | (s["inside"] & ~blank(line))
        return F.struct(
            F.when(opens, put(s)).otherwise(s["blocks"]).alias("blocks"),
            F.when(opens, line).when(inside, joined).otherwise(s["now"]).alias("now"), inside.alias("inside"),
        ).cast(_STATE)

    nothing = F.struct(F.array().cast("array<string>").alias("blocks"), F.lit(None).cast("string").alias("now"), F.lit(False).alias("inside")).cast(_STATE)
    return F.aggregate(lines, nothing, step, put)


def edited(blocks: Column, edits: Column) -> Column:
    """Blocks after an array of edits (kind, block, new, at_start) one after the other.

    An insert puts its block in front or at the end. An upsert replaces every block with the same first line, and inserts if there
    is none. A delete takes away the blocks that equal it whole.
    """
    first = lambda b: F.split_part(b, F.lit("\n"), F.lit(1))

    def step(held: Column, e: Column) -> Column:
        new = F.array(e["block"])
        added = F.when(e["at_start"], F.concat(new, held)).otherwise(F.concat(held, new))
        replaced = F.transform(held, lambda b: F.when(first(b) == first(e["block"]), e["block"]).otherwise(b))
        known = F.exists(held, lambda b: first(b) == first(e["block"]))
        return (
            F.when(e["kind"] == "insert", added).when(e["kind"] == "delete", F.filter(held, lambda b: b != e["block"]))
            .when(known, replaced).otherwise(added)
        )

    return F.aggregate(edits, blocks, step)


def rewritten(lines: Column, section: Column, blocks: Column, between: bool = False, at_end: bool = True) -> Column:
    """The document with the section's lines replaced by `blocks`.

    `between` puts a blank line after each block, `at_end` one after all of them; a section with blocks
    begins with a blank line. Lines before and after stay byte for byte.
    """
    each = F.flatten(F.transform(blocks, lambda b: F.array(b, F.lit("")) if between else F.array(b)))
    parts = [
        F.slice(lines, F.lit(1), section["start"]), F.when(F.size(blocks) > 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")),
        each, *([F.array(F.lit(""))] if at_end else []), F.slice(lines, section["end"] + 1, F.greatest(F.lit(0), F.size(lines) - section["end"])),
    ]
    return F.array_join(F.concat(*parts), "\n")


def section_blocks(docs: DataFrame, heading: str, required: bool = False) -> DataFrame:
    """(doc, blocks) of a section; a document without the heading has null blocks, or with `required` fails the query."""
    rows = docs.select("doc", F.split("text", "\n").alias("lines")).withColumn("s", bounds(F.col("lines"), heading))
    inside = F.slice("lines", F.col("s.start") + 1, F.greatest(F.lit(0), F.col("s.end") - F.col("s.start")))
    return rows.select("doc", F.when(_found(required, heading), blocks_of(inside)).alias("blocks"))


def _found(required: bool, heading: str) -> Column:
    missing = F.raise_error(F.concat(F.lit(f"Section '{heading}' not found in "), F.col("doc").cast("string"))).cast("boolean") if required else F.lit(False)
    return F.when(F.col("s").isNull(), missing).otherwise(F.lit(True))


def edit_documents(docs: DataFrame, edits: DataFrame, heading: str, between: bool = False, at_end: bool = True, required: bool = True) -> DataFrame:
    """(doc, text) after `edits` (doc, seq, kind, block, at_start) of a section, those of a document by `seq`.

    Documents without edits come out as they are. With `required` an edited document without the heading fails the query,
    else it is left as it is, as is a null text. Other columns of `docs` are kept. A document and its edits are one row. An unknown
    kind fails the query.
    """
    kind = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("Unknown edit: "), F.coalesce("kind", F.lit("null")))).cast("string"))
    own = edits.groupBy(F.col("doc").alias("_doc")).agg(
        F.sort_array(F.collect_list(F.struct("seq", kind.alias("kind"), "block", F.coalesce("at_start", F.lit(True)).alias("at_start")))).alias("_edits")
    )
    rows = docs.join(own, F.col("doc") == F.col("_doc"), "left").withColumn("_lines", F.split("text", "\n")).withColumn("s", bounds(F.col("_lines"), heading))
    inside = F.slice("_lines", F.col("s.start") + 1, F.greatest(F.lit(0), F.col("s.end") - F.col("s.start")))
    new = rewritten(F.col("_lines"), F.col("s"), edited(blocks_of(inside), F.col("_edits")), between, at_end)
    touched = F.col("_edits").isNotNull() & F.col("text").isNotNull()
    text = F.when(touched, F.when(_found(required, heading), new).otherwise(F.col("text"))).otherwise(F.col("text"))
    return rows.withColumn("_text", text).select(*[F.col("_text").alias("text") if c == "text" else F.col(c) for c in docs.columns])


def save(docs: DataFrame, path: str) -> None:
    """Write documents (doc, text), many to a file, so that a million notes are no million files; a null text is an empty one."""
    docs.select("doc", F.coalesce("text", F.lit("")).alias("text")).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """(doc, text) of what `save` has written."""
    return spark.read.schema("doc string, text string").parquet(path)


def save_files(docs: DataFrame, path: str) -> None:
    """Write documents (doc, text) as text for other programs, a folder doc=<name> for each: for as many as a file system takes."""
    docs.select("doc", F.coalesce("text", F.lit("")).alias("value")).write.mode("overwrite").partitionBy("doc").option("lineSep", "\n").text(path)


def load_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc, text) of what `save_files` has written."""
    rows = spark.read.schema("value string, doc string").text(path, wholetext=True)
    return rows.select("doc", F.expr("substring(value, 1, length(value) - 1)").alias("text"))
