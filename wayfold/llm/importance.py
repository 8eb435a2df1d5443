"""Importance resampling towards a target distribution over hashed word n-grams."""

from __future__ import annotations

import math
import re
from array import array
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, neutral, ship

#: A word, on lower-cased UTF-8: ASCII letters and digits, and every byte of other characters.
WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Scores of a bin of the histogram that ranks them.
BIN = 256


def scan(text: str | None, longest: int) -> tuple[int, np.ndarray]:
    """(words, CRC-32 of each run of 1 to `longest` words joined by one space).

    One scan: the states of the last `longest` starts are kept, oldest first. A word
    extends each of them by a space and itself and opens a state of its own, and each
    state is then the CRC of a run that ends here.
    """
    words, held, out = 0, [], array("I")
    for match in WORD_BYTES.finditer((text or "").encode().lower()):  # bytes fold A-Z only
        word = match[0]
        words += 1
        if longest > 1:
            spaced = b" " + word
            held = [crc32(spaced, state) for state in (held[1:] if len(held) == longest else held)]
            held.append(crc32(word))
            out.extend(held)
        else:
            out.append(crc32(word))
    return words, np.frombuffer(out, dtype=np.uint32) if out else np.zeros(0, np.uint32)


def bucket_counts(docs: DataFrame, longest: int = 1, buckets: int = 10_000, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket.

    A task adds up its whole partition first and sends one number a bucket; the driver gets `buckets` numbers.
    """
    ship(docs.sparkSession)
    out = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(scan(text.as_py(), longest)[1] % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], schema=out)

    counts = np.zeros(buckets, dtype=np.int64)
    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket int, n long")
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log-ratio of smoothed target share and corpus share, in thousandths, rounded down."""
    n, all_s, all_t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1.0) * (all_s + float(n)) / ((s + 1.0) * (all_t + float(n)))))
        for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
    ], dtype=np.int64)


def gumbel(id_col: Column | str, seed: int) -> Column:
    """A standard Gumbel number of an id, in thousandths, rounded down; no digits for a null id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col) if isinstance(id_col, str) else id_col, F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weigh(
    docs: DataFrame, gain: np.ndarray, longest: int = 1, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The columns of `docs` plus n_words, n_features, weight (floored mean gain; 0 without features) and score.

    Columns of `docs` with these names are replaced. No row leaves its partition.
    """
    ship(docs.sparkSession)
    new = ["n_words", "n_features", "weight", "score"]
    rows, name = neutral(docs.drop(*(c for c in docs.columns if c in new)))
    size = np.uint32(len(gain))

    def run(texts: pa.Array) -> pa.Array:
        out = np.zeros((3, len(texts)), dtype=np.int64)
        for i, text in enumerate(texts):
            words, crc = scan(text.as_py(), longest)
            out[:, i] = words, len(crc), int(gain[crc % size].sum()) // len(crc) if len(crc) else 0
        return pa.StructArray.from_arrays([pa.array(x) for x in out], names=new[:3])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(run, "n_words long, n_features long, weight long")
    return rows.withColumn("_w", udf(F.col(name[text_col]).cast("string"))).select(
        *[F.col(v).alias(k) for k, v in name.items()], "_w.*",
        (F.col("_w.weight") + gumbel(F.col(name[id_col]).cast("long").cast("string"), seed)).alias("score"),
    )


def rank_best(rows: DataFrame, most: int, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(the `most` rows of highest score with their rank from 1, ties by `order`; the other rows).

    A histogram of scores gives each score's first rank, so a row meets only rows of its own score. Scores
    are thousandths of logarithms of counts and lie within 2 ** 17 whatever the input's size, which bounds the
    histogram that is broadcast; its running totals are taken by bins of `BIN` scores, some hundreds in all.
    `rows` is read three times and must give the same rows each time. It may hold no columns rank, _s and _first.
    """
    each = rows.groupBy(F.col("score").alias("_s")).agg(F.count("*").alias("_n")).withColumn("_bin", F.floor(F.col("_s") / BIN))
    bins = each.groupBy("_bin").agg(F.sum("_n").alias("_all"))
    above = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.select("_bin", above("_all", Window.orderBy(F.desc("_bin"))).alias("_before"))
    first = cut(
        each.join(bins, "_bin")
        .withColumn("_first", F.col("_before") + above("_n", Window.partitionBy("_bin").orderBy(F.desc("_s"))))
        .where(F.col("_first") < most).select("_s", "_first")
    )
    nth = F.col("_first") + F.row_number().over(Window.partitionBy("score").orderBy(*order))
    met = rows.join(F.broadcast(first), F.col("score") == F.col("_s")).withColumn("rank", nth.cast("long")).drop("_s", "_first")
    low = rows.join(F.broadcast(first), F.col("score") == F.col("_s"), "left_anti")
    return met.where(F.col("rank") <= most), low.unionByName(met.where(F.col("rank") > most).drop("rank"))


def _weighed(docs: DataFrame, target: DataFrame, longest: int, buckets: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    gain = gains(bucket_counts(docs, longest, buckets, text_col), bucket_counts(target, longest, buckets))
    return weigh(docs, gain, longest, seed, id_col, text_col)


def importance_ranks(
    docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20,
    seed: int = 2024, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Each document's weight towards the target, its score, and its rank in the draw.

    Returns doc_id, text_hash, n_words, n_features, weight, score, rank, a row for each row of `docs`. A feature is a
    run of 1 to `longest` words, its bucket the CRC-32 of its UTF-8 modulo `buckets`. Counts
    of all features of `docs` and of `target` (its column text) give each bucket's gain; a document's weight is the
    floored mean of its features' gains, and its score adds a Gumbel number that depends on seed and id alone, so the
    highest scores are a draw without replacement in proportion to exp(weight / 1000). Of the rows with
    `least_words` words, `percent` in a hundred are drawn: highest scores, ties to the smaller id, then to
    the smaller text hash; null ids come last.

    A null text has no words and weight 0 and is never drawn. Rows that repeat an id are ranked
    one by one. A text is scanned as a stream, however long. Other columns are ignored, and empty tables on
    either side are counts of zero. Texts are read twice and never shuffled.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    rows = cut(_weighed(plain, target, longest, buckets, seed, "doc_id", "text").drop("text"))
    able = F.col("n_words") >= least_words
    most = percent * rows.where(able).count() // 100
    best, low = rank_best(rows.where(able), most, [F.asc_nulls_last("doc_id"), F.asc("text_hash")])
    none = F.lit(None).cast("long")
    return best.unionByName(low.withColumn("rank", none)).unionByName(rows.where(~able).withColumn("rank", none))


def resample(
    docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20,
    seed: int = 2024, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The drawn documents: the columns of `docs` plus n_words, n_features, weight, score and rank.

    Parameters and odd rows as in `importance_ranks`, with the same ranks but among rows alike in id and text. Only rows
    whose score is drawn are shuffled. Columns of `docs` with the new names are replaced.
    """
    new = ["n_words", "n_features", "weight", "score", "rank"]
    rows, name = neutral(docs.drop(*(c for c in docs.columns if c in new)))
    rows = _weighed(rows, target, longest, buckets, seed, name[id_col], name[text_col]).where(F.col("n_words") >= least_words)
    order = [F.col(name[id_col]).cast("long").asc_nulls_last(), F.xxhash64(name[text_col]).asc()]
    best, _ = rank_best(rows, percent * rows.count() // 100, order)
    return best.select(*[F.col(v).alias(k) for k, v in name.items()], *new)


#: The op12 query in DuckDB SQL. DuckDB has no CRC-32, so each distinct word's is folded byte by byte over the table of its polynomial.
SQL = r"""
    WITH RECURSIVE crc_steps(i, k, c) AS (
        SELECT i, 0, CAST(i AS BIGINT) FROM range(256) r(i)
        UNION ALL
        SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(CAST(3988292384 AS BIGINT), c // 2) ELSE c // 2 END FROM crc_steps WHERE k < 8
    ), crc_table AS (
        SELECT list(c ORDER BY i) AS tab FROM crc_steps WHERE k = 8
    ), d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
        FROM documents
    ), b AS (
        SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
        FROM benchmark
    ), dw AS (
        SELECT doc_id, unnest(ws) AS w FROM d
    ), words AS (
        SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM b)
    ), coded AS (
        SELECT w, xor(CAST(4294967295 AS BIGINT), list_reduce(
            list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, octet_length(encode(w))),
                lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT))),
            lambda x, y: xor(x // 256, tab[xor(x % 256, y) + 1]))) % 10000 AS bucket
        FROM words, crc_table
    ), s AS (
        SELECT bucket, count(*) AS n FROM dw JOIN coded USING (w) GROUP BY bucket
    ), t AS (
        SELECT bucket, count(*) AS n FROM b JOIN coded USING (w) GROUP BY bucket
    ), g AS (
        SELECT r.i AS bucket,
               CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + 10000.0::DOUBLE)
                    / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + 10000.0::DOUBLE)))) AS BIGINT) AS gain
        FROM range(10000) r(i) LEFT JOIN s ON s.bucket = r.i LEFT JOIN t ON t.bucket = r.i
    ), wt AS (
        SELECT doc_id, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight
        FROM dw JOIN coded USING (w) JOIN g USING (bucket) GROUP BY doc_id
    ), sc AS (
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
               coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
                   (CAST('0x' || substr(sha256('2024:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
        FROM d LEFT JOIN wt ON d.doc_id = wt.doc_id
    ), rk AS (
        SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS n, 10 * count(*) OVER () // 100 AS most FROM sc WHERE n_features >= 20
    )
    SELECT sc.doc_id, n_features, weight, score, CASE WHEN rk.n <= rk.most THEN CAST(rk.n AS BIGINT) END AS rank
    FROM sc LEFT JOIN rk ON sc.doc_id = rk.doc_id
"""
