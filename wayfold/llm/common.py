"""Shared building blocks: scratch space, gapless numbering, word hashing, block joins."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, release, shared_dir, ship  # noqa: F401  passed on to the operators

#: A word is a maximal run of bytes outside space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


# ---------------------------------------------------------------- scratch space
def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path in whatever store holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def neutral(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame under names that no operator uses, and the map from old names to new ones."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


# ------------------------------------------------------------ gapless numbering
def block_rows(n: int, least: int = 1024) -> int:
    """Rows of a block so that both the blocks and their contents grow with the root of n."""
    return max(least, math.isqrt(max(0, n)) + 1)


def gapless_rank(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each key from 0 without gaps, however hot a key is.

    The order is by a hash of `order`, then by `order`, at every size. A key's rows
    are dealt over ranges of the hash, ranges are counted with map-side aggregation,
    running totals of the counts give each range's first number, and rows are
    numbered inside their range. Rows equal in all of `order` share a range.
    `df` is read several times, so pass a checkpointed frame.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*order))
    most = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    blocks = -(-most // block_rows(most))
    if blocks <= 1:
        w = Window.partitionBy(*keys).orderBy("_hash", *order)
        return hashed.withColumn(name, F.row_number().over(w).cast("long") - 1).drop("_hash")
    dealt = hashed.withColumn("_block", F.floor((F.col("_hash") / F.lit(2.0**64) + F.lit(0.5)) * F.lit(blocks)))
    counts = dealt.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_block").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"),
    )
    on = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    w = Window.partitionBy(*keys, "_block").orderBy("_hash", *order)
    return (
        dealt.withColumn("_row", F.row_number().over(w))
        .join(first, on)
        .withColumn(name, F.col("_first") + F.col("_row") - 1)
        .drop("_hash", "_block", "_b", "_first", "_row", "_n", *[f"_k{i}" for i in range(len(keys))])
    )


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ------------------------------------------------------------------ word hashes
_SPAN = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_TABLES: dict[str, np.ndarray] = {}
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        for name, base in (("up", _P), ("down", inverse)):
            t = np.full(_SPAN, base, dtype=np.uint64)
            t[0] = 1
            _TABLES[name] = np.multiply.accumulate(t)
    return _TABLES["up"], _TABLES["down"]


def _hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _powers()
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        at = start[i]
        j = int(np.searchsorted(end, at + _SPAN, side="right"))
        if j <= i:  # one word longer than the table: fold it span by span
            h = np.uint64(0)
            for a in range(int(at), int(end[i]), _SPAN):
                part = data[a : min(a + _SPAN, int(end[i]))].astype(np.uint64) + np.uint64(1)
                h = mix64(np.array([h + (part * up[: len(part)]).sum(dtype=np.uint64)]))[0]
            out[i] = h
            i += 1
            continue
        s, e = start[i:j] - at, end[i:j] - at
        total = np.zeros(int(e[-1]) + 1, dtype=np.uint64)
        np.cumsum((data[at : at + e[-1]].astype(np.uint64) + np.uint64(1)) * up[: e[-1]], out=total[1:])
        out[i:j] = (total[e] - total[s]) * down[s]
        i = j
    return mix64(out + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and the n + 1 offsets into them; null counts as empty."""
    a = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    raw = a.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def doc_chunks(offsets: np.ndarray, most: int = 4 << 20):
    """Ranges of documents of about `most` bytes, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the documents, and the n + 1 offsets of each document's words.

    `lower` folds A-Z only.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    if lower:
        data = _LOWER[data]
    ink = ~_SPACE[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]  # a text's start parts words too
    first[filled] = ink[filled]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends] = ink[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return _hash_spans(data, start, end), np.searchsorted(start, offsets)


# ------------------------------------------------------------------- row blocks
def finite_vectors(df: DataFrame, id_col: str, vector_col: str, nonzero: bool) -> DataFrame:
    """(vec_id, v): the rows whose vectors can take part.

    Null ids, null vectors and vectors with null or non-finite components are left
    out, with `nonzero` zero vectors too. Rows that repeat both id and vector are one;
    rows that repeat only the id are rows of their own. Other columns are ignored.
    """
    v = F.col(vector_col)
    ok = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    if nonzero:
        ok = ok & F.exists(v, lambda x: x != 0)
    return df.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v")).distinct()


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of equally long lists as a matrix."""
    flat = column.combine_chunks().flatten() if len(column) else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), width)


def top_k_in_blocks(vectors: DataFrame, every: int, k: int, search, score_type: str, row_cells: int = 1 << 20, query_cells: int = 1 << 22) -> DataFrame:
    """Top k of each query against all rows, a block of rows and a block of queries at a time.

    Queries are the rows whose id `every` divides. search(ids, rows, query_ids,
    queries, k) gets matrices and returns (query position, row id, score) arrays of
    at most k rows for each query; block results are merged by score, then id.
    A task holds at most about `row_cells` and `query_cells` numbers, 16,384 rows and
    65,536 queries of width 64, so a row is copied once for 65,536 queries. Only vectors of
    the same length are compared.
    """
    ship(vectors.sparkSession)
    vectors = cut(vectors.withColumn("width", F.size("v")))
    queries = vectors.where(F.pmod("vec_id", F.lit(every)) == 0)
    n, asked, width = vectors.agg(F.count("*"), F.count_if(F.pmod("vec_id", F.lit(every)) == 0), F.max("width")).first()
    width = max(1, width or 1)
    row_blocks, query_blocks = max(1, -(-n * width // row_cells)), max(1, -(-asked * width // query_cells))
    dealt = lambda n, salt: F.pmod(F.xxhash64(F.col("vec_id"), F.lit(salt)), F.lit(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tasks = min(4 * row_blocks * query_blocks, 20_000)
    on = ["row_block", "query_block", "width"]
    rows = vectors.select("vec_id", "v", "width", dealt(row_blocks, 1).alias("row_block"), every_one(query_blocks).alias("query_block"))
    asks = queries.select(
        "vec_id", "v", "width", F.xxhash64("vec_id", "v").alias("ask"), dealt(query_blocks, 2).alias("query_block"), every_one(row_blocks).alias("row_block")
    )
    schema = f"ask long, query_id long, vec_id long, score {score_type}"
    kind = pa.float64() if score_type == "double" else pa.int64()
    out = pa.schema([("ask", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", kind)])

    def block(key, left: pa.Table, right: pa.Table) -> pa.Table:
        width = key[2].as_py()
        ids, ask = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        if not len(ids) or not len(ask):
            return out.empty_table()
        order = np.argsort(ids, kind="stable")
        at, near, score = search(ids[order], matrix(left.column("v"), width)[order], ask, matrix(right.column("v"), width), k)
        return pa.table([right.column("ask").to_numpy()[at], ask[at], near, score], schema=out)

    best = (
        rows.repartition(tasks, *on).groupBy(*on)
        .cogroup(asks.repartition(tasks, *on).groupBy(*on))
        .applyInArrow(block, schema)
    )
    w = Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def strangers(ids: np.ndarray, rows: np.ndarray, me: int, query: np.ndarray) -> np.ndarray:
    """Whether each row is another than the query's own; `ids` ascend."""
    out = np.ones(len(ids), dtype=bool)
    a, b = np.searchsorted(ids, [me, me + 1])
    out[a:b] = (rows[a:b] != query).any(axis=1)
    return out
