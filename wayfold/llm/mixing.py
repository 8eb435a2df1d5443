"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import block_rows, cut, neutral, word_count

CYCLE = (1, 2, 3)
#: Rows of the table of drawn blocks up to which it is broadcast: some 10 MB.
BROADCAST_BLOCKS = 100_000


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Split sum(sizes) by weight; none above `most` times its size, the excess reshared."""
    out = [0.0] * len(sizes)
    free, left = set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
            free.remove(i)
        left = max(0.0, left - sum(out[i] for i in over))
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Deal exact quotas of blocks over shards: a row of quotas for each shard.

    The range of shards is halved again and again. The left half of a node gets its
    share of the node's blocks, and which sources they come from is a multivariate
    hypergeometric draw, as if the blocks had been shuffled and cut in two.
    """
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def split(a: int, b: int, q: np.ndarray) -> None:
        if b - a == 1:
            out[a] = q
            return
        mid = (a + b) // 2
        n = int(q.sum()) * (mid - a) // (b - a)
        left = np.random.default_rng([seed, a, b]).multivariate_hypergeometric(q, n, method="marginals")
        split(a, mid, left)
        split(mid, b, q - left)

    split(0, shards, quotas)
    return out


def _quota_plan(spark, sized: DataFrame, source_col: str, shards: int, seed: int, cycle: tuple, most: int) -> tuple[DataFrame, DataFrame]:
    """(plan, draws): a row for each source, and one for each block of a source with what shards draw of it.

    A source's quota is so many whole passes over its blocks plus the blocks that the rest of
    its target touches in one more pass. `split_quotas` deals the quotas over the shards.
    A shard draws its own range of each source's permuted sequence of (pass, block), and
    nothing else is drawn. In the block that comes last of all, rows are taken in the
    order of their hash until the target is met: plan has the (hash, id) that is taken in part.
    """
    small = cut(sized.select(F.col(source_col).alias("_source"), "mix_size", "_u", F.col("_own").alias("_key")))
    sources = [tuple(r) for r in small.groupBy("_source").agg(F.sum("mix_size"), F.count("*")).collect()]
    sources.sort(key=lambda r: (r[0] is None, (r[0] or "").encode()))
    names = [r[0] for r in sources]
    size = [int(r[1] or 0) for r in sources]
    target = targets(size, [cycle[i % len(cycle)] for i in range(len(sources))], most)
    passes = [min(most, int(t // s)) if s else 0 for s, t in zip(size, target, strict=True)]
    rest = [max(0, round(t) - p * s) if p < most else 0 for s, t, p in zip(size, target, passes, strict=True)]
    blocks = [-(-r[2] // block_rows(r[2], 256)) for r in sources]

    def table(**columns) -> DataFrame:
        return spark.createDataFrame(pa.table({"_name": pa.array(names, pa.string()), **{k: pa.array(v, t) for k, (v, t) in columns.items()}}))

    base = table(_blocks=(blocks, pa.int64()), _rest=(rest, pa.int64()))
    same = F.col("_source").eqNullSafe(F.col("_name"))
    block = F.pmod("_u", F.col("_blocks")).cast("int")
    in_blocks = small.join(base, same).withColumn("_block", block)
    order = Window.partitionBy("_name").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        in_blocks.groupBy("_name", "_block", "_rest").agg(F.sum("mix_size").alias("_words"))
        .withColumn("_before", F.coalesce(F.sum("_words").over(order), F.lit(0))).where(F.col("_before") < F.col("_rest"))
    )
    touched = {r[0]: r[1:] for r in before.groupBy("_name").agg(F.max("_block") + 1, F.max("_before")).collect()}
    partial = [touched.get(n, (0, 0)) for n in names]
    quota = np.array([p * b + m for p, b, (m, _) in zip(passes, blocks, partial, strict=True)], dtype=np.int64)
    ends = np.cumsum(split_quotas(quota, shards, seed), axis=0) if len(names) else np.zeros((shards, 0), np.int64)
    # a place in a source's permuted sequence is an affine map of (pass, block) modulo the quota; this is its inverse
    step = [next(k for k in range(max(1, int(0.618 * q)), 2 * int(q) + 2) if math.gcd(k, int(q)) == 1) if q else 1 for q in quota]
    back = [pow(k, -1, int(q)) if q > 1 else 0 for k, q in zip(step, quota, strict=True)]
    left = [r - x if m else 0 for r, (m, x) in zip(rest, partial, strict=True)]
    last = table(_last=([m - 1 for m, _ in partial], pa.int32()), _left=(left, pa.int64()))
    running = Window.partitionBy("_name").orderBy("_u", F.asc_nulls_first("_key")).rowsBetween(Window.unboundedPreceding, -1)
    met = (
        in_blocks.drop("_name").join(last, same).where(F.col("_block") == F.col("_last"))
        .groupBy("_name", "_left", "_u", "_key").agg(F.sum("mix_size").alias("_words"), F.count("*").alias("_copies"))
        .withColumn("_before", F.coalesce(F.sum("_words").over(running), F.lit(0)))
        .where((F.col("_before") < F.col("_left")) & (F.col("_left") <= F.col("_before") + F.col("_words")))
        .select("_name", "_u", "_key", (F.col("_left") - F.col("_before")).alias("_part"), "_copies")
    )
    cuts = {r[0]: tuple(r[1:]) for r in met.collect()}
    ended = [cuts.get(n, (None, None, None, None)) for n in names]
    plan = table(
        _blocks=(blocks, pa.int64()), mix_source_size=(size, pa.int64()), mix_target=(target, pa.float64()),
        _cut_u=([e[0] for e in ended], pa.int64()), _cut_key=([e[1] for e in ended], pa.string()), _part=([e[2] for e in ended], pa.int64()),
        _copies=([e[3] for e in ended], pa.int64()),
    )
    ranges = table(
        _blocks=(blocks, pa.int64()), _quota=(quota, pa.int64()), _back=(back, pa.int64()), _rest=(rest, pa.int64()),
        _ends=([list(e) for e in ends.T], pa.list_(pa.int64())),
    )
    draws = (
        ranges.select("*", F.posexplode("_ends").alias("shard", "_end"))
        .withColumn("_start", F.when(F.col("shard") > 0, F.get("_ends", F.col("shard") - 1)).otherwise(F.lit(0)))
        .where(F.col("_start") < F.col("_end"))
        .withColumn("_place", F.explode(F.sequence("_start", F.col("_end") - 1)))
        # the product may pass a long's range for large quotas
        .withColumn("_unit", F.pmod(F.col("_place").cast("decimal(18,0)") * F.col("_back").cast("decimal(18,0)"), F.col("_quota").cast("decimal(18,0)")).cast("long"))
        .groupBy(F.col("_name").alias("_of"), F.pmod("_unit", "_blocks").cast("int").alias("_of_block"))
        .agg(F.sort_array(F.collect_list(F.struct(
            F.floor(F.col("_unit") / F.col("_blocks")).cast("int").alias("pass"), "shard",
            ((F.col("_rest") > 0) & (F.col("_unit") == F.col("_quota") - 1)).alias("last"),
        ))).alias("_draws"))
    )
    return plan, F.broadcast(draws) if quota.sum() <= BROADCAST_BLOCKS else draws


def mix_by_row(
    docs: DataFrame, shards: int = 16, seed: int = 29, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", cycle: tuple = CYCLE, most: int = 3,
) -> DataFrame:
    """As `mix`, but a row for each input row: its columns, mix_size, mix_source_size, mix_target and mix_draws.

    mix_draws is an array of (pass, taken, shard, order), without draws of no words.
    """
    plain = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    rows, name = neutral(plain)
    id_col, text_col, source_col = name[id_col], name[text_col], name[source_col]
    sized = rows.withColumns({
        "mix_size": word_count(F.col(text_col)),
        "_u": F.xxhash64(F.col(id_col), F.crc32(F.col(text_col).cast("binary")), F.lit(seed)),
        "_own": F.col(id_col).cast("string"),
    })
    plan, draws = _quota_plan(docs.sparkSession, sized, source_col, shards, seed, cycle, most)
    placed = (
        sized.join(plan, F.col(source_col).eqNullSafe(F.col("_name")))
        .withColumn("_block", F.pmod("_u", F.col("_blocks")).cast("int"))
        .join(draws, F.col("_name").eqNullSafe(F.col("_of")) & (F.col("_block") == F.col("_of_block")), "left")
    )
    at, cut_at = F.struct("_u", F.col("_own").alias("_key")), F.struct(F.col("_cut_u").alias("_u"), F.col("_cut_key").alias("_key"))
    placed = placed.withColumn("_nth", F.lit(0).cast("long"))
    if not plan.where("_copies > 1").isEmpty():  # rows alike share what is left of the target: number those, and no others
        shared = F.col("_copies").isNotNull() & (F.col("_copies") > 1) & (at == cut_at)
        alike = Window.partitionBy("_name", "_u", "_own").orderBy(*name.values())
        placed = placed.where(~shared).unionByName(placed.where(shared).withColumn("_nth", F.row_number().over(alike).cast("long") - 1))
    part = F.floor(F.col("_part") / F.col("_copies")) + (F.col("_nth") < F.pmod("_part", "_copies")).cast("long")
    last = F.when(at < cut_at, F.col("mix_size")).when(at == cut_at, part).otherwise(F.lit(0).cast("long"))
    taken = lambda d: F.when(d["last"], last).otherwise(F.col("mix_size"))
    draws = F.transform("_draws", lambda d: F.struct(
        d["pass"].alias("pass"), taken(d).alias("taken"), d["shard"].alias("shard"), F.xxhash64("_u", d["pass"], F.lit(seed + 1)).alias("order")
    ))
    drawn = F.filter(F.coalesce(draws, F.array().cast("array<struct<pass:int,taken:bigint,shard:int,order:bigint>>")), lambda d: d["taken"] > 0)
    # in a step of its own, or names in its lambdas would find the input's columns
    return placed.withColumn("_drawn", drawn).select(
        *[F.col(v).alias(k) for k, v in name.items()], "mix_size", "mix_source_size", "mix_target", F.col("_drawn").alias("mix_draws")
    )


def mix(docs: DataFrame, *args, **options) -> DataFrame:
    """Draw documents so that sources make up their target shares of the corpus's words.

    Sources in code point order, null last, weigh `cycle`, repeating. A source above
    `most` times its own size is held there and the excess reshared. Each source's
    rows are dealt into blocks by a seeded hash. Quotas of blocks are split among the output
    shards by `split_quotas`; a shard draws its own range of each source's
    permuted blocks. Words are taken until a source's words equal its rounded target, so
    one document at most, or rows alike, is drawn in part.

    Arguments are those of `mix_by_row`. Returns a row for each draw: the input's columns plus mix_size, mix_source_size,
    mix_target, mix_pass, mix_taken (words drawn, from the document's start),
    mix_shard, and mix_order (the local shuffle: the order of a shard's rows). A row
    that the mix does not draw is returned once with mix_taken 0.

    Null texts and texts without words have size 0 and are never drawn. Repeated rows
    and ids, null ids too, are drawn like others, each row by itself; a long text is drawn whole. Some numbers for each source and
    shard reach the driver: 300 bytes a source with 16 shards, so a million sources take 300 MB. Input columns named mix_* are replaced. An empty
    table gives an empty result.
    """
    rows = mix_by_row(docs, *args, **options)
    own = [c for c in rows.columns if c != "mix_draws"]
    return rows.select(*own, F.explode_outer("mix_draws").alias("_d")).select(
        *own, F.coalesce("_d.pass", F.lit(0)).alias("mix_pass"), F.coalesce("_d.taken", F.lit(0)).cast("long").alias("mix_taken"),
        F.col("_d.shard").alias("mix_shard"), F.coalesce("_d.order", F.lit(0)).cast("long").alias("mix_order"),
    )


def with_places(drawn: DataFrame, buckets: int = 256) -> DataFrame:
    """Rows of `mix` with mix_place: the row's place in its shard by mix_order, from 0; null if not drawn.

    mix_order is a hash, so its ranges are even buckets: rows are numbered inside a
    bucket of a shard, from the running total of the buckets before. `drawn` is read
    twice, so pass a checkpointed frame.
    """
    rows = drawn.withColumn("_bucket", F.floor((F.col("mix_order") / F.lit(2.0**64) + F.lit(0.5)) * F.lit(buckets)))
    before = Window.partitionBy("mix_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        rows.where(F.col("mix_shard").isNotNull()).groupBy("mix_shard", "_bucket").agg(F.count("*").alias("_n"))
        .select(F.col("mix_shard").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    )
    others = [c for c in drawn.columns if c not in ("mix_shard", "mix_order")]
    nth = F.row_number().over(Window.partitionBy("mix_shard", "_bucket").orderBy("mix_order", *others))
    return (
        rows.withColumn("_nth", nth)
        .join(first, (F.col("mix_shard") == F.col("_s")) & (F.col("_bucket") == F.col("_b")), "left")
        .select(*drawn.columns, (F.col("_first") + F.col("_nth") - 1).alias("mix_place"))
    )


def with_draws(docs: DataFrame, **options) -> DataFrame:
    """A row for each row of (doc_id, text, source): doc_id, size, source_size, target, taken, and draws: (pass, taken, shard, place).

    Rows that share an id, or have none, stay apart. A null text has size 0 and no draws, a null source is a source like others and
    the last one, equal sizes are ordered by hash, other columns than the three are ignored, and an empty table gives an empty result.
    """
    rows = cut(mix_by_row(docs, **options).drop("text", "source"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())  # of kept rows, so that it is the same each time
    drawn = rows.select("_row", F.explode("mix_draws").alias("_d")).select(
        "_row", F.col("_d.pass").alias("mix_pass"), F.col("_d.taken").alias("mix_taken"), F.col("_d.shard").alias("mix_shard"), F.col("_d.order").alias("mix_order")
    )
    draw = F.struct(F.col("mix_pass").alias("pass"), F.col("mix_taken").alias("taken"), F.col("mix_shard").alias("shard"), F.col("mix_place").alias("place"))
    places = with_places(drawn).groupBy(F.col("_row").alias("_of")).agg(F.sort_array(F.collect_list(draw)).alias("draws"))
    return rows.join(places, F.col("_row") == F.col("_of"), "left").select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        F.aggregate("mix_draws", F.lit(0).cast("long"), lambda a, d: a + d["taken"]).alias("taken"),
        F.coalesce("draws", F.array().cast("array<struct<pass:int,taken:bigint,shard:int,place:bigint>>")).alias("draws"),
    )


def mixed_documents(
    docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", **options
) -> DataFrame:
    """The mixed corpus itself, in the columns of `docs`: a row for each draw, shard after shard, each in its local order.

    Rows are dealt by ranges of (shard, order), so partitions follow each other as the
    rows do, and a shard spreads over as many of them as its size asks for.
    A document drawn in part keeps its first words; `chars_col` follows, if there is one.
    Null and wordless texts are never drawn; rows that repeat an id or a whole row are drawn as documents of their own. Columns of any
    name are kept as they are. An empty table gives an empty result.
    """
    plain, name = neutral(docs)
    named = {k: name[options.pop(k, v)] for k, v in (("id_col", "doc_id"), ("source_col", "source"))}
    rows = mix(plain, text_col=name[text_col], **named, **options).where(F.col("mix_taken") > 0).orderBy("mix_shard", "mix_order")
    text, part = F.col(name[text_col]), F.col("mix_taken") < F.col("mix_size")
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(words, F.lit(1), F.greatest(F.lit(1), F.col("mix_taken").cast("int"))), "")
    out = {c: F.col(v) for c, v in name.items()} | {text_col: F.when(part, head).otherwise(text)}
    if chars_col in out:
        out[chars_col] = F.when(part, F.length(head).cast("long")).otherwise(F.col(name[chars_col]))
    return rows.select(*[v.alias(k) for k, v in out.items()])
