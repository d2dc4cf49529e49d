"""The corpus pipeline: documents to training windows in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents; the last returns the
windows (block, window, piece, doc_id, start_word, n_words, padding).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common, language_id, line_dedup, mixing, ngram_join, packing


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go: no letters, or mostly words of no known language."""
    return language_id.keep_known(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts, and with them documents that had nothing else."""
    cleaned = line_dedup.dedup_lines(docs).where(~((F.col("n_dropped") > 0) & ~F.col("text").rlike(r"\S")))
    return cleaned.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    return ngram_join.drop_near_copies(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights ask for."""
    return mixing.mix_sources(docs)


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows over the documents in order of doc_id."""
    return packing.pack(docs)


STAGES = [
    ("language ID", known_languages),
    ("line dedup", repeated_lines),
    ("n-gram Jaccard join", near_copies),
    ("mixing", mixed_sources),
    ("packing", packed_windows),
]

ORACLE_SQL = None  # neither the language model, nor pivotal rounding, nor the packing can be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows made of the documents in sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if (name, stage) != STAGES[-1]:
            docs = common.written(docs, "stage-" + name.lower().replace(" ", "-"))
    return docs
