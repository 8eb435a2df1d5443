"""A log of store operations replayed in order: what each get and search saw, and what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .namespaces import ASKS, SLICE, nearest_in_blocks

# The kinds of an operation.
KINDS = ("get", "put", "delete", "search")
BEFORE = -(2**63)
AFTER = 2**63 - 1
#: Operations of a run of the log inside which one task orders those of a key.
RUN = 100_000
#: Spans of a run of searches, at least.
LEAST = 1_024


def checked(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, rejected): operations whose kind is known, and the others with their reason."""
    known = F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))
    reason = F.concat(F.lit("Unknown operation type: "), F.coalesce("kind", F.lit("undefined")))
    return log.where(known), log.where(~known).withColumn("reason", reason)


def _writes(table: DataFrame, log: DataFrame) -> DataFrame:
    """What the table holds, as puts before all others, and the log's puts and deletes: key, seq, deleted, value, vector."""
    held = table.select("key", F.lit(BEFORE).cast("long").alias("seq"), F.lit(False).alias("deleted"), "value", "vector")
    made = log.where(F.col("kind").isin("put", "delete")).select("key", "seq", (F.col("kind") == "delete").alias("deleted"), "value", "vector")
    return held.unionByName(made)


def gets(table: DataFrame, log: DataFrame) -> DataFrame:
    """(seq, key, found, value) of each get: the last put of its key before it, unless a delete came after that.

    The operations of a key are ordered in runs of the log; the last write of the earlier runs is carried
    in from one summary row a run, so a key that a third of all operations name spreads over as many tasks as there are runs.
    """
    writes = _writes(table, log).select("key", "seq", F.struct("deleted", "value").alias("w"))
    asked = log.where("kind = 'get'").select("key", "seq", F.lit(None).cast(writes.schema["w"].dataType).alias("w"))
    rows = writes.unionByName(asked).withColumn("run", F.when(F.col("seq") == BEFORE, F.lit(-1)).otherwise(F.floor(F.col("seq") / RUN)))
    inside = Window.partitionBy("key", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("key", "run").agg(F.max_by("w", F.when(F.col("w").isNotNull(), F.col("seq"))).alias("last"))
    earlier = Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("key").alias("_k"), F.col("run").alias("_r"), F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    seen = rows.withColumn("near", F.last("w", ignorenulls=True).over(inside)).where("w IS NULL")
    out = seen.join(carried, F.col("key").eqNullSafe(F.col("_k")) & (F.col("run") == F.col("_r"))).withColumn("v", F.coalesce("near", "carried"))
    found = F.coalesce(~F.col("v.deleted"), F.lit(False))
    return out.select("seq", "key", found.alias("found"), F.when(found, F.col("v.value")).alias("value"))


def spans(table: DataFrame, log: DataFrame) -> DataFrame:
    """(key, value, vector, since, until): each put with the numbers between which it was what the key held.

    Written like `gets`, over the log read backwards: the first write of the later runs is carried in.
    """
    rows = _writes(table, log).withColumn("run", F.when(F.col("seq") == BEFORE, F.lit(-1)).otherwise(F.floor(F.col("seq") / RUN)))
    inside = Window.partitionBy("key", "run").orderBy("seq")
    starts = rows.groupBy("key", "run").agg(F.min("seq").alias("first"))
    later = Window.partitionBy("key").orderBy("run").rowsBetween(1, 1)
    carried = starts.select(F.col("key").alias("_k"), F.col("run").alias("_r"), F.first("first").over(later).alias("carried"))
    out = rows.withColumn("next", F.lead("seq").over(inside)).join(carried, F.col("key").eqNullSafe(F.col("_k")) & (F.col("run") == F.col("_r")))
    return out.where("NOT deleted").select("key", "value", "vector", F.col("seq").alias("since"), F.coalesce("next", "carried", F.lit(AFTER)).alias("until"))


def searches(table: DataFrame, log: DataFrame, k: int = 10) -> DataFrame:
    """(seq, rank, key, distance) of each search: the k nearest of the rows that the store held at that moment.

    The log is dealt into runs of about as many spans as the store has keys, `LEAST` at least, and of `ASKS` searches on the mean at most. A span
    goes to every run that it reaches into, so there are about two copies of each, or one a run of `ASKS` searches if that is more, and a search
    is compared with what its own run held and not with the whole history.
    """
    held = cut(spans(table, log).where("vector IS NOT NULL").drop("value"))
    asks = log.where("kind = 'search'").select(F.col("seq").alias("ask"), "seq", "vector")
    n, keys = held.agg(F.count("*"), F.approx_count_distinct("key")).first()
    asked, low, high = asks.agg(F.count("*"), F.coalesce(F.min("seq"), F.lit(0)), F.coalesce(F.max("seq"), F.lit(0))).first()
    width = -(-(high - low + 1) // max(1, n // max(keys, LEAST), -(-asked // ASKS)))
    run = lambda seq: F.expr(f"({seq} - {low}L) div {width}L")
    dealt = held.where((F.col("since") < high) & (F.col("until") > low)).select(
        "key", "vector", "since", "until", F.explode(F.sequence(run(f"greatest(since, {low}L)"), run(f"least(until, {high}L)"))).alias("run")
    )
    runs = -(-(high - low + 1) // width)
    slices, parts = max(1, -(-2 * keys // SLICE)), max(1, -(-asked // (runs * ASKS)))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = dealt.withColumn("slice", F.pmod(F.xxhash64("key", "since"), F.lit(slices)).cast("int")).withColumn("part", every(parts))
    asks = asks.withColumn("run", run("seq")).withColumn("part", F.pmod(F.xxhash64("seq"), F.lit(parts)).cast("int")).withColumn("slice", every(slices))
    near = nearest_in_blocks(dealt, asks, ["run", "slice", "part"], k, spans=True)
    return near.select(F.col("ask").alias("seq"), "rank", "key", F.col("_distance").alias("distance"))


def remaining(table: DataFrame, log: DataFrame) -> DataFrame:
    """(key, value, vector) after the last operation: one aggregation with map-side reduction."""
    last = _writes(table, log).groupBy("key").agg(F.max_by(F.struct("deleted", "value", "vector"), "seq").alias("v"))
    return last.where("NOT v.deleted").select("key", "v.value", "v.vector")
