"""From raw documents to packed training sequences: quality rules, near copies, repeated passages, packing.

Every stage takes and returns the columns of `documents`, the last one the pieces of sequences. `n_chars` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from msgwarden.llm.catalog import bpe_encoder
from msgwarden.llm.packing import pack
from msgwarden.llm.quality import keep_good
from msgwarden.llm.repeats import without_repeats
from msgwarden.llm.simhash import keep_first


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the word rules and the compression bands."""
    return keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group within two bits of one another, over shingles of three words."""
    return keep_first(docs, words=3, radius=2)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without strings of 200 bytes that also start elsewhere."""
    return without_repeats(docs, chars_col="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of up to 2048 tokens."""
    return pack(docs, bpe_encoder)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]
#: Compression, suffix order and token ids are not expressible in SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
