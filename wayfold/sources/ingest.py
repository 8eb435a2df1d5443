"""Visits from JSON messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codec import decode_payload
from ..functions.url import page_id
from ..session import ship

VISIT = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("page_loaded_at", T.StringType()),
    T.StructField("referrer", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("referrer_timestamp", T.StringType()),
    T.StructField("tab_id", T.LongType()),
    T.StructField("group_id", T.StringType()),
    T.StructField("opener_tab_id", T.LongType()),
    T.StructField("_corrupt", T.StringType()),
])


def _parse(value: Column) -> Column:
    return F.from_json(value, VISIT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})


def parse_visits(messages: DataFrame, value: str = "value", decode: bool = True) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of JSON messages; works on streams too.

    A message needs a url and a page_loaded_at that is a time. The content is decoded
    from base64 and zstd, or kept where that fails. Rejected messages keep their text and a
    reason.
    """
    ship(messages.sparkSession)
    p = messages.withColumn("v", _parse(F.col(value)))
    reason = (
        F.when(F.col("v._corrupt").isNotNull(), "not a visit object")
        .when(F.coalesce("v.url", F.lit("")) == "", "url is missing")
        .when(F.try_to_timestamp(F.col("v.page_loaded_at")).isNull(), "page_loaded_at is no time")
    )
    p = p.withColumn("reason", reason)
    good = p.where("reason IS NULL").select("v.*").drop("_corrupt").withColumns({
        "id": page_id(F.col("url"), F.col("page_loaded_at")), "ts": F.try_to_timestamp("page_loaded_at"),
    })
    if decode:
        good = good.withColumn("content", decode_payload(F.col("content")))
    return good, p.where("reason IS NOT NULL").select(F.col(value).alias("value"), "reason")
