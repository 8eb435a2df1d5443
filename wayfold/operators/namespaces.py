"""Vector namespaces kept as inverted lists, searched with many query vectors at once."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, ship
from .vectors import predicate

#: Rows of a list that one task compares with the queries that probe it.
SLICE = 65_536
#: Queries that one task compares with a slice.
ASKS = 16_384
#: Numbers of a product of matrices that are held at once.
CELLS = 1 << 22
#: Most lists, which bounds what a probe sends to executors.
MOST_LISTS = 4096


def _matrix(column, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)


def _measured(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of `m` from `q`."""
    return np.square(m - q).sum(axis=1)


def _nearest(m: np.ndarray, q: np.ndarray, k: int):
    """Yield (ask, rows, distances): the k rows of `m` nearest to each row of `q`, ties to smaller rows.

    A product of matrices tells which rows may be among them, its error allowed for; those are measured exactly. Nothing larger than
    `CELLS` numbers is held.
    """
    own, length = np.square(q).sum(axis=1), np.square(m).sum(axis=1)
    safe = np.isfinite(own).all() and np.isfinite(length).all() and len(m) > k
    step = max(1, CELLS // max(1, len(m)))
    for a in range(0, len(q), step):
        if safe:
            rough = length[None, :] - 2 * (q[a : a + step] @ m.T)  # less the ask's own length, which orders nothing
            error = 1e-9 * (own[a : a + step] + length.max()) + np.finfo(float).tiny
            near = rough <= (np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * error)[:, None]
        for i in range(a, min(a + step, len(q))):
            at = np.flatnonzero(near[i - a]) if safe else np.arange(len(m))
            d = _measured(m[at], q[i])
            best = np.argsort(d, kind="stable")[:k]
            yield i, at[best], d[best]


def _alike(m: np.ndarray):
    """(first, number): where each different row of `m` stands first, and which of those each row is."""
    whole = np.ascontiguousarray(m).view(np.dtype((np.void, m.shape[1] * m.itemsize))).ravel()
    _, first, number = np.unique(whole, return_index=True, return_inverse=True)
    return first, number.ravel()


def _nearest_live(owner: np.ndarray, m: np.ndarray, since: np.ndarray, until: np.ndarray, q: np.ndarray, seq: np.ndarray, k: int):
    """Yield (asks, rows, distances): the k rows of `m` nearest to each row of `q` among those with since < seq < until, ties to smaller rows.

    Rows must stand in the order of their keys, whose numbers are `owner`. Asks alike are measured once, and so are rows that hold one vector
    under one key at several times. The nearest of the rows that all asks see bound how far a row of some may be; which asks
    see a row is counted for `CELLS` pairs of row and ask at once.
    """
    turn = np.argsort(seq, kind="stable")
    begin, end = np.searchsorted(seq[turn], since, "right"), np.searchsorted(seq[turn], until, "left")  # the asks in order that see a row
    whole = (begin == 0) & (end == len(q))
    always, some = np.flatnonzero(whole), np.flatnonzero(~whole & (begin < end))
    begin, end = begin[some], end[some]
    first, kind = _alike(q[turn])
    asked = q[turn[first]]
    steady = [(always[at], d) for _, at, d in _nearest(m[always], asked, k)]
    last = np.array([d[k - 1] if len(d) == k and d[k - 1] == d[k - 1] else np.inf for _, d in steady])
    alike = _alike(m[some])[1]
    _, first, row = np.unique(owner[some] * (len(some) + 1) + alike, return_index=True, return_inverse=True)
    place, row = some[first], row.ravel()
    rows = m[place]
    own, length = np.square(asked).sum(axis=1), np.square(rows).sum(axis=1)
    safe = np.isfinite(own).all() and np.isfinite(length).all()
    step = max(1, CELLS // max(1, len(place)))
    for a in range(0, len(q), step):
        width = min(step, len(q) - a)
        live = np.zeros((len(place), width + 1), np.int32)
        np.add.at(live, (row, np.clip(begin - a, 0, width)), 1)
        np.subtract.at(live, (row, np.clip(end - a, 0, width)), 1)
        live = np.cumsum(live, axis=1, out=live)[:, :-1]
        kinds, of = np.unique(kind[a : a + width], return_inverse=True)
        near = np.broadcast_to(live.any(axis=1), (len(kinds), len(place)))
        if safe and len(place):
            rough = length[None, :] - 2 * (asked[kinds] @ rows.T)
            bound, all_see = last[kinds] - own[kinds], live.min(axis=1) > 0
            if all_see.sum() >= k:
                bound = np.minimum(bound, np.partition(rough[:, all_see], k - 1, axis=1)[:, k - 1])
            near = near & (rough <= (bound + 2e-9 * (own[kinds] + length.max()) + np.finfo(float).tiny)[:, None])
        for j, mine in enumerate(np.split(np.argsort(of.ravel(), kind="stable"), np.cumsum(np.bincount(of.ravel()))[:-1])):
            at = np.flatnonzero(near[j])
            held, d = steady[kinds[j]]
            where, d = np.concatenate([held, place[at]]), np.concatenate([d, _measured(rows[at], asked[kinds[j]])])
            best = np.lexsort((where, d))
            seen = np.concatenate([np.ones((len(held), len(mine)), np.int32), live[np.ix_(at, mine)]])[best]
            wanted = np.clip(k - (np.cumsum(seen, axis=0) - seen), 0, seen)
            r, i = np.nonzero(wanted)
            r, i = np.repeat(r, wanted[r, i]), np.repeat(i, wanted[r, i])
            yield turn[a + mine[i]], where[best[r]], d[best[r]]


def nearest_in_blocks(rows: DataFrame, asks: DataFrame, on: list[str], k: int, spans: bool = False) -> DataFrame:
    """(ask, key, _distance, rank): the k rows nearest to each ask among those that share its block.

    `rows` has key, vector and the block columns `on`, `asks` has ask, vector and the same. A block is compared by one
    task, which sends k rows an ask on; blocks are merged by squared Euclidean distance, then key. With `spans` a row counts only for
    asks whose `seq` lies between its `since` and `until`. Rows and asks without a vector, or of another length, take no part.
    """
    ship(rows.sparkSession)
    key, ask = rows.schema["key"].dataType, asks.schema["ask"].dataType
    ok = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x))
    # columns under numbers of their own, as both sides may come from one table
    sized = [df.where(ok).withColumn("_width", F.size("vector")).select(*[F.col(c).alias(c) for c in (*df.columns, "_width")]) for df in (rows, asks)]
    schema = T.StructType([T.StructField("ask", ask), T.StructField("key", key), T.StructField("_distance", T.DoubleType())])

    def block(keys, left: pa.Table, right: pa.Table) -> pa.Table:
        width, out = keys[-1].as_py(), []
        left = left.sort_by("key")
        m, q = _matrix(left.column("vector"), width), _matrix(right.column("vector"), width)
        if spans:
            since, until = (left.column(c).to_numpy() for c in ("since", "until"))
            seq = right.column("seq").to_numpy()
            owner = pc.fill_null(left.column("key").combine_chunks().dictionary_encode().indices, -1).to_numpy().astype(np.int64)
            out.extend(_nearest_live(owner, m, since, until, q, seq, k))
        else:
            out.extend((np.full(len(at), i), at, d) for i, at, d in _nearest(m, q, k))
        at = np.concatenate([a for a, *_ in out]) if out else np.zeros(0, np.int64)
        near = np.concatenate([b for _, b, _ in out]) if out else np.zeros(0, np.int64)
        return pa.table({
            "ask": right.column("ask").take(pa.array(at)), "key": left.column("key").take(pa.array(near)),
            "_distance": pa.array(np.concatenate([d for *_, d in out]) if out else np.zeros(0), pa.float64()),
        })

    by = [*on, "_width"]
    found = sized[0].groupBy(*by).cogroup(sized[1].groupBy(*by)).applyInArrow(block, schema)
    w = Window.partitionBy("ask").orderBy("_distance", "key")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_many(rows: DataFrame, asks: DataFrame, k: int, filters: Mapping[str, object] | None = None, slices: int | None = None) -> DataFrame:
    """The k rows (key, vector, ...) nearest to each ask (ask, vector), exactly: every row is compared with every ask.

    Rows are dealt into slices and asks into parts, and each slice meets each part in a task of its own, which sends on k rows an ask.
    The work is rows x asks by nature; a task's is bounded.
    """
    rows = rows.where(predicate(filters))
    slices, parts = slices or max(1, -(-rows.count() // SLICE)), max(1, -(-asks.count() // ASKS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    dealt = rows.select("key", "vector", of("key", slices).alias("slice"), every(parts).alias("part"))
    everywhere = asks.select("ask", "vector", of("ask", parts).alias("part"), every(slices).alias("slice"))
    return nearest_in_blocks(dealt, everywhere, ["slice", "part"], k)


def _closest(centroids: np.ndarray, n: int, vector: str) -> Column:
    """The `n` closest lists of a vector, nearest first; null without a vector of the centroids' length."""

    def run(vectors: pa.Array) -> pa.Array:
        out = []
        for v in vectors.to_pylist():
            if v is None or len(v) != centroids.shape[1] or any(x is None or x != x for x in v):
                out.append(None)
                continue
            d = np.square(centroids - np.array(v)).sum(axis=1)
            out.append(np.argsort(d, kind="stable")[:n].astype(np.int32))
        return pa.array(out, pa.list_(pa.int32()))

    run.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<int>")(F.col(vector).cast("array<double>"))


class VectorNamespace:
    """Rows (key, vector, ...) at `path`, a folder for each inverted list, beside the lists' centroids.

    A row lies in the list of its closest centroid. A search reads only the lists that its queries probe.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, rows: DataFrame, lists: int | None = None, sample: int = 50_000, seed: int = 7) -> None:
        """Write the namespace. Centroids are fitted on at most `sample` rows, those of least key hash; every row is indexed.

        Without `lists` there are about as many as the root of the rows, `MOST_LISTS` at most. Rows whose vector is null or of another length
        than most lie in a list of their own, which searches do not probe.
        """
        from pyspark.ml.clustering import KMeans  # here, as the workers that compare blocks import this module and do without
        from pyspark.ml.functions import array_to_vector

        ship(self.spark)
        rows = cut(rows)
        widths = rows.where("vector IS NOT NULL").groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
        width, n = (widths[0]["w"], widths[0]["count"]) if widths else (0, 0)
        able = rows.where((F.size("vector") == width) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
        some = able.orderBy(F.xxhash64("key"), "key").limit(sample).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
        lists = min(MOST_LISTS, lists or math.isqrt(n) + 1)
        if n:
            centroids = np.array(KMeans(k=lists, seed=seed, maxIter=10).fit(some).clusterCenters())
        else:
            centroids = np.zeros((0, max(1, width)))
        kept = rows.withColumn("list", F.coalesce(F.get(_closest(centroids, 1, "vector"), F.lit(0)), F.lit(-1)))
        kept.hint("rebalance", "list").sortWithinPartitions("list", "key").write.partitionBy("list").parquet(f"{self.path}/rows")
        named = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
        self.spark.createDataFrame(named, "list int, vector array<double>").coalesce(1).write.parquet(f"{self.path}/centroids")

    def append(self, rows: DataFrame) -> None:
        """More rows, of keys that the namespace does not have, into the lists that there are."""
        kept = rows.withColumn("list", F.coalesce(F.get(_closest(self.centroids(), 1, "vector"), F.lit(0)), F.lit(-1)))
        kept.hint("rebalance", "list").sortWithinPartitions("list", "key").write.mode("append").partitionBy("list").parquet(f"{self.path}/rows")

    def centroids(self) -> np.ndarray:
        """At most `MOST_LISTS` rows."""
        got = self.spark.read.parquet(f"{self.path}/centroids").orderBy("list").collect()
        return np.array([r["vector"] for r in got]) if got else np.zeros((0, 1))

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def search(self, asks: DataFrame, k: int = 10, probes: int = 8, filters: Mapping[str, object] | None = None) -> DataFrame:
        """(ask, key, _distance, rank): the k nearest rows to each ask (ask, vector) in its `probes` closest lists, scored exactly.

        With as many probes as lists the result is exact. Lists that nobody probes are pruned as partitions; a long list is
        dealt into slices and many queries of a list into parts, and each slice meets each part.
        """
        centroids = self.centroids()
        asked = cut(asks.select("ask", "vector", F.explode(_closest(centroids, probes, "vector")).alias("list")))
        wanted = [r[0] for r in asked.select("list").distinct().collect()]  # at most as many as there are lists
        rows = self.rows().where(F.col("list").isin(wanted) & predicate(filters))
        sizes = rows.groupBy("list").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
        probed = asked.groupBy("list").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("parts"))
        sizes = F.broadcast(cut(sizes.join(probed, "list")))  # a row a list
        of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        dealt = rows.join(sizes, "list").select("key", "vector", "list", of("key", "slices").alias("slice"), every("parts").alias("part"))
        asked = asked.join(sizes, "list").select("ask", "vector", "list", of("ask", "parts").alias("part"), every("slices").alias("slice"))
        return nearest_in_blocks(dealt, asked, ["list", "slice", "part"], k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(asks, wanted, hit, recall): how many of the exact neighbours were found."""
    both = exact.select("ask", "key").join(found.select("ask", "key", F.lit(1).alias("hit")), ["ask", "key"], "left")
    return both.agg(F.countDistinct("ask").alias("asks"), F.count("*").alias("wanted"), F.count("hit").alias("hit")).withColumn("recall", F.col("hit") / F.col("wanted"))
