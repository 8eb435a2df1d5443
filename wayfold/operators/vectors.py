"""Vector search and a key-value view over namespaces of vectors."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import recency_score

# The operators that a search predicate may name.
COMPARATORS = {
    "=": operator.eq, "!=": operator.ne, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
}


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, in the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def predicate(filters: Mapping[str, object] | None) -> Column:
    """{column: value} or {column: {operator: value}}, all joined by and."""
    parts = []
    for name, wanted in (filters or {}).items():
        pairs = wanted.items() if isinstance(wanted, Mapping) else [("=", wanted)]
        for op, value in pairs:
            if op not in COMPARATORS:
                raise ValueError(f"unknown comparison {op!r}")
            parts.append(COMPARATORS[op](F.col(name), F.lit(value)))
    return functools.reduce(operator.and_, parts, F.lit(True))


def search(rows: DataFrame, query: Sequence[float] | None, k: int = 10, filters: Mapping[str, object] | None = None) -> DataFrame:
    """The k nearest rows (key, vector, ...) with _distance; without a query the first k by key.

    The predicate is applied before the cut, and the cut is a top-k in every
    partition followed by a merge of k rows of each.
    """
    kept = rows.where(predicate(filters))
    if query is None:
        return kept.orderBy("key").limit(k)
    q = F.array(*[F.lit(float(x)) for x in query])
    return kept.withColumn("_distance", squared_l2(F.col("vector"), q)).orderBy("_distance", "key").limit(k)


def search_grouped(rows: DataFrame, query: Sequence[float], group: str, k: int) -> DataFrame:
    """The k nearest rows of each group, with their rank."""
    q = F.array(*[F.lit(float(x)) for x in query])
    w = Window.partitionBy(group).orderBy("_distance", "key")
    return (
        rows.withColumn("_distance", squared_l2(F.col("vector"), q)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    )


def rerank_by_recency(
    rows: DataFrame, query: Sequence[float], now: Column, k: int = 3, days_back: int | None = None, min_date: Column | None = None
) -> DataFrame:
    """Fetch k * k nearest of the recent rows, then order by closeness and age together.

    Recent is at most `days_back` days old, or, where that is not given, updated at `min_date` or later.
    """
    since = min_date if days_back is None else now - F.make_dt_interval(days=F.lit(days_back))
    kept = rows if since is None else rows.where(F.col("updated_at") >= since)
    near = search(kept, query, k * k)
    age = (F.unix_micros(now) - F.unix_micros("updated_at")) / 86_400e6
    return near.withColumn("score", recency_score(F.col("_distance"), age)).orderBy(F.desc("score"), "key").limit(k)


def similar_notes(rows: DataFrame, query: Sequence[float], k: int = 3, needed: str = "body") -> DataFrame:
    """Fetch k * k nearest, drop those that lack what is `needed`, keep k."""
    return search(rows, query, k * k).where(F.col(needed).isNotNull()).orderBy("_distance", "key").limit(k)


def latest(rows: DataFrame) -> DataFrame:
    """The key-value view of an append-only namespace: the last write of each key, deletions gone.

    Rows have key, written_at, seq, deleted and the payload. One aggregation with map-side
    reduction, no sort.
    """
    payload = [c for c in rows.columns if c not in ("key", "written_at", "seq", "deleted")]
    last = rows.groupBy("key").agg(F.max_by(F.struct("deleted", "written_at", *payload), F.struct("written_at", "seq")).alias("v"))
    return last.where(~F.col("v.deleted")).select("key", "v.written_at", *[f"v.{c}" for c in payload])


def get(rows: DataFrame, key: object) -> DataFrame:
    """The row of a key, if any."""
    return latest(rows.where(F.col("key") == F.lit(key)))


def multi_get(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """All wanted keys in one join; null payload where there is none."""
    return keys.join(latest(rows.join(keys, "key", "left_semi")), "key", "left")


def preview(rows: DataFrame, n: int = 5) -> DataFrame:
    """The n rows of least key."""
    return rows.orderBy("key").limit(n)


def with_contents(titles: DataFrame, contents: DataFrame, key: str = "key", content: str = "content") -> DataFrame:
    """Each title with its content, empty where there is none, by one join."""
    return titles.join(contents.select(key, content), key, "left").withColumn(content, F.coalesce(content, F.lit("")))


def similar_to_episodes(hits: DataFrame, episodes: DataFrame) -> DataFrame:
    """Episodes of the hits, in the order of closeness; hits without an episode drop out."""
    return hits.join(episodes, F.col("key") == F.col("id")).orderBy("_distance", "key")


def namespaces(names: DataFrame, prefix: str = "", suffix: str = "", depth: int | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Names that start and end so, cut to a depth of path parts, distinct, a page of them."""
    kept = names.where(F.startswith("name", F.lit(prefix)) & F.endswith("name", F.lit(suffix)))
    if depth is not None:
        kept = kept.withColumn("name", F.array_join(F.slice(F.split("name", "/"), 1, depth), "/")).distinct()
    return kept.orderBy("name").offset(offset).limit(limit)
