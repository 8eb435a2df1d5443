"""Streaming queries, run over what is there and then read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import cut, remove, shared_dir
from ..sources.tables import table
from ..streaming import ingest, orphans
from .browsing import ORPHANS
from .registry import query

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stream(spark, sf_dir):
    e = ingest.parquet_stream(spark, f"{sf_dir}/events.parquet")
    return e.select(
        F.md5(F.concat_ws(":", F.concat(F.lit("https://"), "event_type", F.lit(".example.com/"), F.get_json_object("props", "$.k")),
                          F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))).alias("id"),
        F.col("user_id").alias("tab_id"), F.when(F.col("event_type").isin("click", "view"), F.col("user_id") + 1).alias("opener_tab_id"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def _collected(spark, frame, what):
    """Run a stream over all that is available and return what it wrote; its folders go."""
    base = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    try:
        ingest.start(frame, f"{base}/out", f"{base}/log").awaitTermination()
        return cut(spark.read.schema(frame.schema).parquet(f"{base}/out"))
    finally:
        remove(spark, base)


@query("SELECT CAST(user_id AS BIGINT) AS tab_id, count(*) AS visits FROM events GROUP BY 1")
def stream_ingest_batches(spark, sf_dir):
    v = _stream(spark, sf_dir)
    twice = v.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("n")  # every visit is sent again
    return _collected(spark, ingest.deduplicated(twice), "ingest").groupBy("tab_id").agg(F.count("*").alias("visits"))


@query(f"""
    WITH {ORPHANS}
    SELECT a.opener_tab_id, count(*) AS children FROM arrivals a
    WHERE a.opener_tab_id IS NOT NULL AND EXISTS (SELECT 1 FROM arrivals p WHERE p.tab_id = a.opener_tab_id) GROUP BY 1
""")
def stream_orphans(spark, sf_dir):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        out = _collected(spark, orphans.attach_orphans(_stream(spark, sf_dir)), "orphans")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old) if old else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    openers = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view")).select(
        F.md5(F.concat_ws(":", F.concat(F.lit("https://"), "event_type", F.lit(".example.com/"), F.get_json_object("props", "$.k")),
                          F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))).alias("id"),
        (F.col("user_id") + 1).alias("opener_tab_id"),
    )
    return out.where("state = 'attached'").join(openers, "id").groupBy("opener_tab_id").agg(F.count("*").alias("children"))
