"""Sharding by longest-processing-time scheduling."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, gapless_rank


def lpt_counts(sizes: list[int], counts: list[int], shards: int) -> np.ndarray:
    """LPT over size classes: how many groups of each class every shard gets.

    `sizes` descend; class i holds counts[i] interchangeable groups of sizes[i].
    Groups go one by one to the least-loaded shard (ties: the lowest number) through
    a heap. For a large class the rounds in which every pop is known in advance
    are taken at once: n pops take the n smallest of load + m * size, so all below
    the highest level with at most n of them are taken, and the heap does the rest.
    """
    loads = [0] * shards
    out = np.zeros((len(sizes), shards), dtype=np.int64)
    for i, (s, n) in enumerate(zip(sizes, counts, strict=True)):
        taken = [0] * shards
        if s > 0 and n > 2 * shards:
            below = lambda level: [max(0, -(-(level - x) // s)) for x in loads]  # noqa: B023, E731
            lo, hi = min(loads), min(loads) + s * (n + 1)
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if sum(below(mid)) <= n else (lo, mid - 1)
            taken = below(lo)
        loads = [x + t * s for x, t in zip(loads, taken, strict=True)]
        heap = [(x, j) for j, x in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(n - sum(taken)):
            x, j = heap[0]
            heapq.heapreplace(heap, (x + s, j))
            taken[j] += 1
            loads[j] += s
        out[i] = taken
    return out


def lpt_shards(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", row_overhead: int = 8
) -> DataFrame:
    """Put documents into shards of nearly equal bytes; equal texts stay together.

    Returns doc_id, size (UTF-8 bytes plus `row_overhead`), text_crc32, law
    ("bytes"), shard, slot (gapless in the shard) and grown_shard (null).

    Only the histogram of group sizes reaches the driver: k different sizes total
    k * k / 2 bytes at least, so it has at most sqrt(2 * corpus bytes) rows. Groups of
    one size are interchangeable; they are numbered without gaps, and the number
    picks the shard from the class's counts.

    Null texts have size `row_overhead`, a null checksum, and form one group, apart
    from the empty texts. Null or repeated ids are allowed: every row gets its own
    slot. Of a very long text only the size and checksums travel. An empty table gives an empty result; other columns are ignored.
    """
    text = F.col(text_col)
    rows = cut(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(row_overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b"null").cast("binary")).alias("same"),
    ))
    groups = cut(rows.groupBy("same").agg(F.sum("size").alias("group_size")))
    classes = groups.groupBy("group_size").count().toPandas().sort_values("group_size", ascending=False)
    plan = lpt_counts(classes["group_size"].tolist(), classes["count"].tolist(), shards)
    bounds = docs.sparkSession.createDataFrame(
        pa.table({
            "group_size": pa.array(classes["group_size"], pa.int64()),
            "bounds": pa.array(list(np.cumsum(plan, axis=1)), pa.list_(pa.int64())),
        })
    )
    placed = (
        gapless_rank(groups, ["group_size"], ["same"], "nth")
        .join(bounds, "group_size")
        .select("same", F.size(F.filter("bounds", lambda b: b <= F.col("nth"))).alias("shard"))
    )
    sharded = cut(rows.join(placed, "same"))
    return gapless_rank(sharded, ["shard"], ["doc_id", "same"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
