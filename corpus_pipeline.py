"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and gives a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarc.llm import line_dedup, minhash, mixing, quality_crf, sentencepiece
from lexarc.llm.store import unused, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality_crf.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused(docs, "_quality")
    return quality_crf.scored(docs, model, score).where(F.col(score) >= quality_crf.KEEP_AT).drop(score)


def line_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later copies of repeated line runs."""
    return line_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return minhash.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every text."""
    return sentencepiece.encoded(docs)


STAGES = [("quality classifier", quality), ("line dedup", line_copies), ("near-duplicate removal", near_copies), ("source mixing", mix), ("piece encoding", pieces)]

#: Training a classifier and sampling pieces are not SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, "stage")
    return docs
