"""Framed messages, whole-document edits, and pages classified by a provider."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import providers
from ..operators import decisions, documents
from ..session import cut, ship
from ..sources import frames, ingest, tables
from ..streaming.replay import folder, run_through
from .memory import CONFIG
from .registry import query


def _packed(texts: pa.Array) -> pa.Array:
    import zstandard

    pack = zstandard.ZstdCompressor(level=3)
    return pa.array([None if t.as_py() is None else base64.b64encode(pack.compress(t.as_py().encode())).decode() for t in texts], pa.string())


_packed.__annotations__ = {"texts": pa.Array, "return": pa.Array}


def _framed(spark, sf_dir, path):
    """Pages as visit messages with packed contents, some without a url or a time, written as frames."""
    ship(spark)
    p, kind = tables.table(spark, sf_dir, "pages"), F.col("page_id") % 10
    body = F.to_json(F.struct(
        F.when(kind != 0, F.col("url")).alias("url"), F.when(kind == 1, "soon").otherwise("2024-01-02T03:04:05Z").alias("page_loaded_at"),
        F.arrow_udf(_packed, "string")("html").alias("content"), F.col("page_id").alias("tab_id"),
    ))
    frames.write_frames(p.select(F.when(kind == 2, "[not an object").otherwise(body).alias("value")), f"{path}/in")


FRAMED = """
    SELECT CASE page_id % 10 WHEN 0 THEN 'url is missing' WHEN 1 THEN 'page_loaded_at is no time' WHEN 2 THEN 'not a visit object' ELSE 'accepted' END AS state,
           CASE WHEN page_id % 10 > 2 THEN page_id END AS page_id, CASE WHEN page_id % 10 > 2 THEN md5(html) END AS content
    FROM pages
"""


def _sorted_out(messages):
    good, bad = ingest.parse_visits(messages.where("reason IS NULL").select("value"))
    none = lambda kind: F.lit(None).cast(kind)
    rejected = bad.select("reason").unionByName(messages.where("reason IS NOT NULL").select("reason"))
    return good.select(F.lit("accepted").alias("state"), F.col("tab_id").alias("page_id"), F.md5("content").alias("content")).unionByName(
        rejected.select(F.col("reason").alias("state"), none("long").alias("page_id"), none("string").alias("content"))
    )


@query(FRAMED)
def ingest_framed(spark, sf_dir):
    """Length-prefixed messages read back, unpacked and sorted into accepted and rejected."""
    with folder(spark, "frames") as path, frames.small_batches(spark):
        _framed(spark, sf_dir, path)
        return cut(_sorted_out(frames.read_frames(spark, f"{path}/in")))


@query(FRAMED)
def stream_framed(spark, sf_dir):
    """The same from a stream, a file a batch."""
    with folder(spark, "frames") as path, frames.small_batches(spark):
        _framed(spark, sf_dir, path)
        messages = cut(run_through(frames.stream_frames(spark, f"{path}/in", 1).drop("path"), path))
        return cut(_sorted_out(messages))


@query("""
    WITH b AS (
        SELECT page_id, list_filter([
            CASE WHEN page_id % 2 = 0 THEN '- [[first]]' END,
            CASE WHEN page_id % 3 <> 0 THEN '- [[' || url || ']]' END,
            CASE WHEN page_id % 5 = 0 THEN '- [[other]]' || chr(10) || '  - changed' ELSE '- [[other]]' || chr(10) || '  - detail' END,
            CASE WHEN page_id % 7 = 0 THEN '- [[last]]' END], lambda x: x IS NOT NULL) AS blocks
        FROM pages
    )
    SELECT page_id, '# ' || page_id || chr(10) || chr(10) || '## Notes' || chr(10) || chr(10) ||
           CASE WHEN page_id % 2 = 0 OR page_id % 3 = 0 OR page_id % 5 = 0 OR page_id % 7 = 0
                THEN chr(10) || array_to_string(blocks, chr(10)) || chr(10) || chr(10)
                ELSE '- [[' || url || ']]' || chr(10) || '- [[other]]' || chr(10) || '  - detail' || chr(10) || chr(10) END || '## Next' || chr(10) || 'tail ' AS text
    FROM pages JOIN b USING (page_id)
""")
def documents_edit(spark, sf_dir):
    """A note for each page, saved, loaded, its section edited in place, saved and loaded again."""
    p = tables.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc"), "url")
    link = F.concat(F.lit("- [["), "url", F.lit("]]"))
    text = F.concat_ws("\n", F.concat(F.lit("# "), "doc"), F.lit(""), F.lit("## Notes"), F.lit(""), link, F.lit("- [[other]]"), F.lit("  - detail"), F.lit(""), F.lit("## Next"), F.lit("tail "))
    every = lambda n, seq, kind, block, start: p.where(F.col("doc").cast("long") % n == 0).select(
        "doc", F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), block.alias("block"), F.lit(start).alias("at_start")
    )
    edits = every(2, 1, "insert", F.lit("- [[first]]"), True)
    for e in (every(3, 2, "delete", link, True), every(5, 3, "upsert", F.lit("- [[other]]\n  - changed"), True), every(7, 4, "upsert", F.lit("- [[last]]"), False)):
        edits = edits.unionByName(e)
    with folder(spark, "notes") as path:
        documents.save(p.select("doc", text.alias("text")), f"{path}/one")
        documents.save(documents.edit_documents(documents.load(spark, f"{path}/one"), edits, "## Notes"), f"{path}/two")
        return cut(documents.load(spark, f"{path}/two").select(F.col("doc").cast("long").alias("page_id"), "text"))


@query(r"""
    WITH w AS (
        SELECT doc_id, list_filter(string_split_regex(lower(substr(text, 1, 2000)), '\s+'), lambda x: x <> '') AS ws FROM documents
    ), s AS (
        SELECT doc_id, len(ws) AS n,
               len(list_filter(ws, lambda x: list_contains(['how', 'what', 'why', 'guide', 'introduction', 'the', 'of'], trim(x, '.,!?')))) / greatest(1, len(ws)) AS share
        FROM w
    ), c AS (
        SELECT doc_id, coalesce(n > 0 AND share >= 0.05, false) AS known, share FROM s
    )
    SELECT doc_id, CASE WHEN known THEN 'knowledge' ELSE 'other' END AS page_type,
           CASE WHEN known THEN least(1.0, round(0.5 + share, 6)) ELSE 0.5 END AS confidence, known AND round(0.5 + share, 6) >= 0.7 AS decision,
           CASE WHEN known AND round(0.5 + share, 6) >= 0.7 THEN NULL WHEN NOT known THEN 'type_not_allowed' ELSE 'low_confidence' END AS reason
    FROM c
""")
def classified_decisions(spark, sf_dir):
    """Every document through a classifier provider, its own answer through the filter's decision."""
    d = tables.table(spark, sf_dir, "documents")
    c = d.withColumn("c", providers.classification(spark, F.col("source"), F.lit(None).cast("string"), F.col("text"))).select("doc_id", "c.*")
    args = (F.col("page_type"), F.col("confidence"), F.col("should_process"), CONFIG)
    return c.select("doc_id", "page_type", "confidence", decisions.should_process(*args).alias("decision"), decisions.filter_reason(*args).alias("reason"))
