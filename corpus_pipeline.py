"""From raw documents to packed token sequences, in five stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import circulant_minhash, common, cotrain, line_dedup, mixing, packing


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the co-trained classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return cotrain.classify(docs, labels).where("good").select(*docs.columns)


def line_winnowing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later repeats of runs of 50 words or more; n_chars follows the text."""
    return line_dedup.with_lengths(line_dedup.dedup_lines(docs)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate component: five-word shingles, 0.8.

    Of what stays, later repeats of passages of 50 words are deleted: `line_winnowing`
    sees only repeats of whole lines, and near copies are found better while whole.
    """
    left = common.cut(circulant_minhash.deduplicated(docs, words=5, percent=80).select(*docs.columns))
    common.release(spark)
    return line_dedup.with_lengths(line_dedup.dedup_passages(left)).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their target shares."""
    return mixing.mixed_documents(docs)


def window_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack into sequences of 1024; each piece carries its token ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_winnowing),
    ("minhash_near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("packing", window_packing),
]

#: Classifier fitting, sketching and tokenising are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again."""
    folder = common.scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for i, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            path = f"{folder}/{i}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
        return common.cut(docs)
    finally:
        common.remove(spark, folder)
