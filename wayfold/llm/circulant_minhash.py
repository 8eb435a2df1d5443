"""Near-duplicate detection with circulant MinHash, banding and exact verification."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, doc_chunks, mix64, neutral, release, ship, text_buffers, word_hashes

CELLS = 1 << 20
#: 64-bit words of the bitmap that bounds the intersection of two sets.
BITMAP_WORDS = 16
#: A link at the threshold may miss every band with this probability at most.
MISS = 1e-6
#: Members of a bucket that one task compares with its pivots.
SLICE = 4096
_STATE: dict = {}


def bands_for(percent: int) -> tuple[int, int]:
    """(bands, rows in a band) for a similarity threshold in percent."""
    rows = 8 if percent >= 85 else 6 if percent >= 70 else 4
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** rows))), rows


def _permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    if coordinates not in _STATE:
        rng = np.random.default_rng(1009)
        sigma, pi = (rng.permutation(CELLS).astype(np.int32) for _ in range(2))
        wide = np.concatenate([pi, pi[:coordinates]])
        _STATE[coordinates] = sigma, np.lib.stride_tricks.sliding_window_view(wide, coordinates)
    return _STATE[coordinates]


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """All coordinates from two permutations of the cells.

    The first permutation scatters the shingles. Coordinate k is the least value of
    the second permutation, shifted circularly by k, so one contiguous read of the
    second permutation serves all coordinates of a shingle.
    """
    sigma, shifted = _permutations(coordinates)
    at = sigma[(shingles >> np.uint64(44)).astype(np.int64)]
    out = np.full(coordinates, CELLS, dtype=np.int32)
    for i in range(0, len(at), 1024):
        np.minimum(out, shifted[at[i : i + 1024]].min(axis=0), out=out)
    return out


def shingle_sets(texts: pa.Array, words: int):
    """Yield each text's sorted distinct shingle hashes, in order.

    With fewer words the whole sequence is the one shingle; without words the set is empty.
    """
    data, offsets = text_buffers(texts)
    for a, b in doc_chunks(offsets):
        own = offsets[a : b + 1]
        h, at = word_hashes(data[own[0] : own[-1]], own - own[0])
        sh = h[: max(0, len(h) - words + 1)]
        for j in range(1, words):
            sh = mix64(sh * np.uint64(0x9FB21C651E98DF25) + h[j : j + len(sh)])
        for i in range(b - a):
            lo, hi = int(at[i]), int(at[i + 1])
            if hi - lo >= words:
                yield np.unique(sh[lo : hi - words + 1])
            elif hi > lo:
                x = np.array([hi - lo], dtype=np.uint64)
                for v in h[lo:hi]:
                    x = mix64(x * np.uint64(0xA0761D6478BD642F) + v)
                yield x
            else:
                yield np.zeros(0, np.uint64)


def _signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, t, n_shingles, a, b, bands): a and b identify the set, bands the buckets."""
    out = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("n_shingles", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("bands", pa.list_(pa.int64()))])
    factors = np.random.default_rng(31).integers(1, 1 << 62, (bands, rows), dtype=np.uint64) | np.uint64(1)

    def run(batches):
        for batch in batches:
            n, a, b, keys = [], [], [], []
            for u in shingle_sets(batch.column(2), words):
                n.append(len(u))
                a.append(u.sum(dtype=np.uint64))
                b.append(mix64(u + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64))
                if len(u):
                    sig = signature(u, bands * rows).reshape(bands, rows).astype(np.uint64)
                    keys.append(mix64((sig * factors).sum(axis=1, dtype=np.uint64)).view(np.int64))
                else:
                    keys.append(np.zeros(0, np.int64))
            signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), signed(a), signed(b), pa.array(keys, pa.list_(pa.int64()))], schema=out
            )

    return docs.mapInArrow(run, "doc_id long, t long, n_shingles long, a long, b long, bands array<long>")


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """The bits that a set's shingles hash to."""
    at = (shingles >> np.uint64(5)) & np.uint64(64 * BITMAP_WORDS - 1)
    bits = np.zeros(64 * BITMAP_WORDS, dtype=np.uint8)
    bits[at.astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    out = pa.schema([("sid", pa.int64()), ("s", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            s = list(shingle_sets(batch.column(1), words))
            columns = [[u.view(np.int64) for u in s], [bitmap(u) for u in s]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.list_(pa.int64())) for c in columns]], schema=out)

    return docs.mapInArrow(run, "sid long, s array<long>, bits array<long>")


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for the nodes of undirected `edges` (u, v).

    Alternates large-star and small-star steps, which keep components and end as
    stars around each least node. Every step is a join with map-side minima; nothing
    but a checksum reaches the driver.
    """
    e = cut(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        joined = e.join(least, "u")
        e = cut(
            joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        )
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        last = now


def _shared_sizes(sets: DataFrame) -> DataFrame:
    """(sid, n, core, bits): a set's size, how many of its shingles any other set has, and its bitmap."""
    own = (
        sets.select("sid", F.explode("s").alias("x")).groupBy("x")
        .agg(F.max("sid").alias("last"), F.min("sid").alias("sid")).where("sid = last")
        .groupBy("sid").agg(F.count("*").alias("own"))
    )
    n = F.size("s").cast("long")
    # a row that repeats its set's row exactly brings the set again
    return sets.select("sid", n.alias("n"), "bits").join(own, "sid", "left").select(
        "sid", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("core"), "bits"
    ).dropDuplicates(["sid"])


def _linked(docs: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame | None:
    """(node, component) of the sets that confirmed links connect, by sid; None if there is no link.

    `docs` has doc_id, t and text; `reps` has a row for each distinct set: its sid, its bands,
    and doc_id and t of a row that holds it.

    A shingle that no other set has lies in no intersection. So a pair's intersection is
    at most the smaller `core`, and a pair that this bound rules out is dropped before
    its sets are read: copies that were all edited apart from each other do not meet.

    Rows of a bucket are not paired with each other. In each round the members with the
    fewest shingles of their own are its pivots, 1, then 17, 273, ... of them. A pivot is
    compared with the later members that are not yet in its component, and confirmed
    links merge components. A bucket's members are dealt into slices of about `SLICE`, and
    its pivots go to every slice. After the first round two sets meet only in the least
    bucket that they share, and only if their bitmaps allow a link: a bit that one set
    has alone is a shingle outside the intersection, so that holds at most the common
    bits and the shingles that share a bit with another of their set. A bucket is done when one component holds it or all members
    have been pivots. So every candidate pair is ruled out exactly, compared, or lies
    in one component.
    """

    def crowded(rows: DataFrame) -> DataFrame:
        """Rows whose bucket has more than one, with the bucket's `members`."""
        many = rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
        return rows.join(many, "key")

    met = cut(crowded(reps.select(F.explode("bands").alias("key"), "sid")).select("key", "sid"))
    ids = met.select("sid").distinct()
    if ids.isEmpty():
        return None
    holders = reps.select("sid", "doc_id", "t").join(ids, "sid")
    held = (F.col("doc_id").eqNullSafe(F.col("_d"))) & (F.col("t") == F.col("_t"))
    holders = holders.withColumnsRenamed({"doc_id": "_d", "t": "_t"})
    sets = cut(_sets(docs.join(holders, held).select("sid", "text"), words))
    able = cut(_shared_sizes(sets).where(100 * F.col("core") >= percent * F.col("n")))
    buckets = cut(crowded(met.join(able.drop("bits"), "sid")))
    ones = lambda *maps: sum(
        (F.bit_count(functools.reduce(Column.bitwiseAND, [F.get(m, F.lit(i)) for m in maps])) for i in range(BITMAP_WORDS)), F.lit(0)
    )
    label: DataFrame | None = None
    tested, pivots = 0, 1
    order = F.struct((F.col("n") - F.col("core")).alias("own"), "sid")
    slices = F.ceil(F.col("members") / SLICE).cast("int")
    while True:
        rows = buckets.withColumn("component", F.col("sid")) if label is None else (
            buckets.join(label.withColumnRenamed("node", "sid"), "sid", "left")
            .withColumn("component", F.coalesce("component", "sid"))
        )
        if tested:
            open_ = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
            rows = rows.where(F.col("members") > tested + 1).join(open_, "key")
            if tested == 1:  # few sets are left: from now on each knows all its buckets, and its bitmap
                rows = rows.join(buckets.groupBy("sid").agg(F.collect_list("key").alias("keys")), "sid").join(
                    able.select("sid", "bits", (F.col("n") - ones("bits")).alias("hidden")), "sid"
                )
            rows = cut(rows)
            if rows.isEmpty():
                return label
            buckets = rows.drop("component")
        w = Window.partitionBy("key").orderBy(order)
        pivot = (
            rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= pivots)
            .where(F.col("nth") > tested)
            .select(
                "key", order.alias("uo"), F.col("sid").alias("u"), F.col("n").alias("un"), F.col("core").alias("uc"), F.col("component").alias("ug"),
                *[F.col(c).alias(f"u_{c}") for c in ("keys", "bits", "hidden") if tested],
                F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"),
            )
        )
        most = F.least("core", "uc")
        apart = (order > F.col("uo")) & (F.col("component") != F.col("ug"))
        near = lambda most: 100 * most >= percent * (F.col("n") + F.col("un") - most)
        meet = apart & near(most)
        if tested:
            both = ones("bits", "u_bits") + F.least("hidden", "u_hidden")
            meet = meet & near(both) & (F.array_min(F.array_intersect("keys", "u_keys")) == F.col("key"))
        sliced = rows.withColumn("slice", F.pmod(F.xxhash64("sid"), slices).cast("int"))
        pairs = sliced.join(pivot, ["key", "slice"]).where(meet).select("u", F.col("sid").alias("v")).distinct()
        common = F.size(F.array_intersect("us", "vs"))
        union = F.size("us") + F.size("vs") - common
        links = (
            pairs.join(sets.select(F.col("sid").alias("v"), F.col("s").alias("vs")), "v")
            .join(sets.select(F.col("sid").alias("u"), F.col("s").alias("us")), "u")
            .where(100 * common >= percent * union).select("u", "v")
        )
        links = cut(links)
        if not links.isEmpty():
            if label is not None:
                links = links.unionByName(label.select(F.col("node").alias("u"), F.col("component").alias("v")))
            label = connected(links)
        release(docs.sparkSession)
        tested, pivots = pivots, 16 * pivots + 1


def _grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Each row's doc_id, t (the text's hash), n_shingles, component_id, and `class`: a key of the component itself.

    Rows without words have a null component_id and class; so has the component_id of a component without any id.
    """
    bands, rows = bands_for(percent)
    marks = cut(_signatures(docs.select("doc_id", "t", "text"), words, bands, rows))
    able = marks.where(F.col("n_shingles") > 0)
    same = cut(able.groupBy("a", "b", "n_shingles").agg(F.min("doc_id").alias("rep")))  # null where no row of the set has an id
    same = cut(same.withColumn("sid", F.monotonically_increasing_id()))  # kept, so that it is numbered once
    set_of = same.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("n_shingles").alias("_n"), "rep", "sid")
    on = (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & (F.col("n_shingles") == F.col("_n"))
    reps = able.join(set_of, on & F.col("doc_id").eqNullSafe(F.col("rep"))).select("sid", "doc_id", "t", "bands").dropDuplicates(["sid"])
    label = _linked(docs, reps, words, percent)
    if label is None:
        classes = set_of.withColumnRenamed("sid", "class")
    else:
        tied = set_of.join(label.withColumnRenamed("node", "sid"), "sid", "left").withColumn("class", F.coalesce("component", "sid"))
        # the least id of each class; most classes are one set, whose least id is known
        least = tied.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("rep").alias("least"))
        classes = tied.join(least, "component", "left").select("_a", "_b", "_n", F.coalesce("least", "rep").alias("rep"), "class")
    return marks.select("doc_id", "t", "n_shingles", "a", "b").join(classes, on, "left").select(
        "doc_id", "t", "n_shingles", F.col("rep").alias("component_id"), "class"
    )


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Each document's near-duplicate component: doc_id, n_shingles, component_id, kept.

    A-Z is lower-cased; a set holds the distinct `words`-word shingles. Documents are
    linked when 100 * intersection >= percent * union, on their whole sets of 64-bit
    shingle hashes. Equal sets are linked as one first; the rest meets in the buckets
    of a circulant MinHash. component_id is the least doc_id reachable.

    A document without words is alone. A row without an id links like any other, and others through it; it gives a
    component no name, so component_id is null where no row reachable has an id, and such a row's kept is true. Rows that repeat an id are documents of their own with that
    name, linked by their own texts. A very long text is one set, held whole by one task. Other
    columns are ignored. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    component = F.coalesce("component_id", "doc_id")
    return _grouped(docs, words, percent).select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay: one row of each component, in the columns of `docs`.

    That is the row with the least id, of several with that id the one whose text has the least
    hash. Of rows that repeat both id and text, one stays; rows with a null id all stay.
    """
    ship(docs.sparkSession)
    rows, name = neutral(docs)
    text, own = name["text"], F.col(name["doc_id"]).cast("long")
    keyed = rows.withColumns({"_id": own, "_t": F.xxhash64(text)})
    grouped = cut(_grouped(keyed.select(F.col("_id").alias("doc_id"), F.col("_t").alias("t"), F.col(text).alias("text")), words, percent))
    first = grouped.where((F.col("doc_id") == F.col("component_id"))).groupBy("class").agg(F.min("t").alias("first"))
    stay = grouped.where(F.col("doc_id").isNotNull()).join(first, "class", "left").where(
        F.col("class").isNull() | ((F.col("doc_id") == F.col("component_id")) & (F.col("t") == F.col("first")))
    )
    stay = cut(stay.groupBy(F.col("doc_id").alias("_i"), F.col("t").alias("_s")).agg(F.count("*").alias("_n")))
    left = keyed.join(stay, (F.col("_id") == F.col("_i")) & (F.col("_t") == F.col("_s")))
    if not stay.where("_n > 1").isEmpty():
        left = left.where("_n = 1").unionByName(left.where("_n > 1").dropDuplicates(["_id", "_t"]))
    return left.unionByName(keyed.where(F.col("_id").isNull()), allowMissingColumns=True).select(*[F.col(v).alias(k) for k, v in name.items()])
