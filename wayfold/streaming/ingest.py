"""Visit ingest as a stream: idempotent by id, in micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def deduplicated(visits: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each id once, for repeats that come within `late` of each other in event time."""
    return visits.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def start(visits: DataFrame, path: str, checkpoint: str, available_now: bool = True, interval: str = "1 second"):
    """Write a stream of visits as Parquet; exactly once by the sink's own log."""
    w = visits.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)).start()


def each_batch(visits: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Run `apply` on every micro-batch, sorted by time so that the outcome does not depend on arrival order in it."""

    def run(batch: DataFrame, number: int) -> None:
        apply(batch.orderBy("ts", "id"), number)

    return visits.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parquet_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A Parquet file or folder as a stream with the schema that it has."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*")


def windowed_counts(visits: DataFrame, size: str = "1 hour", late: str = "10 minutes", slide: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Visits of each event-time window, late ones dropped by the watermark; with `slide` windows overlap."""
    return visits.withWatermark("ts", late).groupBy(F.window("ts", size, slide), *by).agg(F.count("*").alias("n"))


def opener_join(children: DataFrame, openers: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Stream-stream join: each child (id, opener_tab_id, ts) with every visit of its opener tab (id, tab_id, ts) up to `within` before it.

    A child without any comes out with a null opener once both watermarks have passed what could still match it.
    Either side's state is bounded by the interval and the watermarks.
    """
    c = children.select(F.col("id").alias("child_id"), "opener_tab_id", F.col("ts").alias("child_ts")).withWatermark("child_ts", late)
    o = openers.select(F.col("id").alias("opener_id"), "tab_id", F.col("ts").alias("opener_ts")).withWatermark("opener_ts", late)
    on = F.expr(f"opener_tab_id = tab_id AND opener_ts <= child_ts AND opener_ts >= child_ts - INTERVAL {within}")
    return c.join(o, on, "left_outer").select("child_id", "opener_tab_id", "child_ts", "opener_id", "opener_ts")


def merge_once(visits: DataFrame, path: str, checkpoint: str, key: str = "id", order: str = "ts"):
    """Keep each key once and for ever: the first batch that brings it wins, inside a batch the least `order`.

    A micro-batch becomes the folder batch=<number> beside those before it, and holds the keys that they do not.
    A batch that runs again looks only at lower numbers and overwrites its own folder, so it changes nothing, and repeats
    are recognised however many days lie between them. Rows without a key are kept, every one. A batch of B keys reads
    the key column of what is kept and shuffles by key; nothing reaches the driver.
    """
    spark = visits.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        once = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*batch.columns), F.struct(order, F.xxhash64(*batch.columns))).alias("_r")).select("_r.*")
        if number and _exists(spark, path):
            kept = spark.read.schema(T.StructType([batch.schema[key], T.StructField("batch", T.LongType())])).parquet(path)
            once = once.join(kept.where(F.col("batch") < number).select(key), key, "left_anti").select(*batch.columns)
        once.unionByName(batch.where(F.col(key).isNull())).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return visits.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def progress_rows(query) -> list[dict]:
    """What a running or ended stream says of each batch: rows in, rows held as state, rows dropped as late, and milliseconds."""
    out = []
    for p in query.recentProgress:
        ops = p.stateOperators
        out.append({
            "batch": p.batchId, "rows_in": p.numInputRows, "state_rows": sum(o.numRowsTotal for o in ops),
            "dropped_late": sum(o.numRowsDroppedByWatermark for o in ops), "took_ms": p.batchDuration,
        })
    return out


def queue_statistics(spark: SparkSession, query) -> DataFrame:
    """A row a batch of `progress_rows`: what has come in so far, what waits as state, what came too late."""
    rows = spark.createDataFrame([tuple(r.values()) for r in progress_rows(query)], "batch long, rows_in long, state_rows long, dropped_late long, took_ms long")
    return rows.groupBy("batch").agg(*[F.max(c).alias(c) for c in rows.columns[1:]])
