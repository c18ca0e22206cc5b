"""The corpus pipeline: quality sampling, language identification, near-duplicate removal, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import langid, minhash, packing, quality
from textloom.llm.common import table
from textloom.tables import forget, scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the importance resampling doesn't draw go."""
    return quality.resample(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no known language has the least share go."""
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicate texts the row of the smallest id stays."""
    return minhash.deduplicated(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a document, with its bin."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality_classifier), ("language ID", language_id), ("MinHash near-dedup", near_dedup), ("best-fit packing", best_fit_packing)]

#: Three of the stages fit or search in ways that SQL can't express; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; all but the last write what they keep to the shared folder, where the next one reads it. What a
    stage has read is deleted once its own table is written."""
    docs, path = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            before, path = path, scratch(spark, f"stage{i}")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
            if before:
                forget(spark, before)
    return docs
