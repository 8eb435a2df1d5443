"""The registered query of each operator, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_forest, arc_convert, circulant_minhash, cotrain, fill_middle, importance, language_id, line_dedup, mixing, packing, sharding, topk
from . import unigram_count


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 by bytes."""
    return sharding.lpt_shards(_table(spark, sf_dir, "documents"), 24)


def op2_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every 20th vector."""
    return ann_forest.nearest(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op3_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return cotrain.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select(
        "doc_id", "content_score", "meta_score", "score", "good"
    )


def op4_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes from each document, and each draw's shard and place in it."""
    return mixing.with_draws(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op5_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components on 3-word shingles at 0.85."""
    return circulant_minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op6_term_at_a_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products for every 50th vector."""
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through ARC files to WARC files and back."""
    return arc_convert.archive_round_trip(_table(spark, sf_dir, "pages"))


def op8_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return unigram_count.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later repeats of runs of lines."""
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op11_codepoint_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the fill-in-the-middle form of all documents, and of the texts rebuilt from it."""
    done = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda text: F.sha2(F.col(text) if isinstance(text, str) else text, 256)
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha("fim_text").alias("output_sha256"), sha(fill_middle.restored()).alias("restored_sha256")
    )


def op12_crc_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark, its score and its rank in the draw."""
    return importance.importance_ranks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank"
    )


def op13_ftrl_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those whose id is not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", language_id.held_out().alias("held_out"))
    model = language_id.fit(docs.where(~F.col("held_out")).select("text", "lang"))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lpt_sharding, op2_prefix_forest, op3_cotraining, op4_weighted_mix, op5_circulant_minhash,
        op6_term_at_a_time, op7_arc_to_warc, op8_bin_slack_packing, op9_unigram_counts, op10_line_winnowing, op11_codepoint_fim, op12_crc_ring, op13_ftrl_ngrams,
    )
}

ORACLES: dict[str, str] = {
    "op10_line_winnowing": line_dedup.SQL,
    "op11_codepoint_fim": fill_middle.SQL,
    "op12_crc_ring": importance.SQL,
    "op6_term_at_a_time": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id,
                   CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id
            WHERE a.vec_id % 50 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
        )
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
    """,
}
