"""Summaries kept by day and merged over any window: sketches instead of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of a distinct-count sketch's registers: a relative error of about 1.04 / 2 ** 7.
LG = 14
#: A quantile sketch's parameter: a rank error of about 0.7 %.
K = 400


def daily(rows: DataFrame, time: str, distinct: str, value: str, dims: Sequence[str] = ()) -> DataFrame:
    """(day, *dims, n, distinct_sketch, value_sketch, least, most): one row of bounded size a day and group.

    Null values are in n alone, as are null members of `distinct`; a group without any has a null sketch.
    """
    return rows.groupBy(F.to_date(time).alias("day"), *dims).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(distinct, LG).alias("distinct_sketch"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), K).alias("value_sketch"), F.min(value).alias("least"), F.max(value).alias("most"),
    )


def merged(days: DataFrame, dims: Sequence[str | Column] = ()) -> DataFrame:
    """The summaries of all days of each group as one; over no dims, of everything."""
    return days.groupBy(*dims).agg(*_merges())


def _merges() -> list[Column]:
    return [
        F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch", False).alias("distinct_sketch"),
        F.kll_merge_agg_double("value_sketch", K).alias("value_sketch"), F.min("least").alias("least"), F.max("most").alias("most"),
    ]


def over_sets(days: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """The merged summaries of several groupings at once, with `level` as the grouping id; what a grouping leaves out is null."""
    dims = list(dict.fromkeys(d for s in sets for d in s))
    return days.groupingSets([[F.col(d) for d in s] for s in sets], *[F.col(d) for d in dims]).agg(*_merges(), F.grouping_id().alias("level"))


def rolling(days: DataFrame, width: int, dims: Sequence[str] = ()) -> DataFrame:
    """For each day that has rows, the merged summary of it and the `width` - 1 days before it.

    Each day's summary is sent to the days whose windows hold it, `width` small rows in all, and merged with map-side
    aggregation; no window orders the days of a group in one task.
    """
    own = days.select(*dims, F.col("day").alias("_own")).distinct()
    spread = days.withColumn("_own", F.explode(F.sequence(F.col("day"), F.date_add("day", width - 1)))).drop("day")
    summed = spread.groupBy("_own", *dims).agg(*_merges())
    return summed.join(own, ["_own", *dims], "left_semi").withColumnRenamed("_own", "day")


def estimates(summaries: DataFrame, quantiles: Sequence[float] = (0.5,)) -> DataFrame:
    """The summaries with members (estimated distinct count) and q<percent> columns in place of the sketches."""
    out = summaries.withColumn("members", F.coalesce(F.hll_sketch_estimate("distinct_sketch"), F.lit(0)))
    for q in quantiles:
        out = out.withColumn(f"q{round(100 * q)}", F.kll_sketch_get_quantile_double("value_sketch", F.lit(float(q))))
    return out.drop("distinct_sketch", "value_sketch")
