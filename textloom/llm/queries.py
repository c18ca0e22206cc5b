"""Queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, langid, linefreq, minhash, packing, quality, sharding, urlfilter, warc
from .common import table


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours among all vectors of those whose id is divisible by 100."""
    return ann.neighbours(table(spark, sf_dir, "embeddings"), queries=lambda vec_id: vec_id % 100 == 0)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.decide(table(spark, sf_dir, "pages"), urlfilter.default_entries(spark))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's tokens, and the hash of the text that they decode to."""
    back = bpe.encode(table(spark, sf_dir, "documents"), back=True)
    return back.select("doc_id", "n_tokens", "token_ids", F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def op4_language_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_mixtures(table(spark, sf_dir, "documents"))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages"), warc.DATE))


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linefreq.remove_frequent(table(spark, sf_dir, "documents"), keep=["doc_id", "text"])


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": urlfilter.ORACLE, "op5_warc_derivatives": warc.ORACLE, "op6_virtual_slots": sharding.ORACLE, "op7_line_frequency": linefreq.ORACLE}
