"""A corpus from raw documents to token counts: five of the operators of ``tracemill.llm`` as stages.

Every stage works on all that the one before it kept; a stage's rows are written as Parquet and read
again before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import bpe, language, mixing, quality, simhash
from tracemill.llm.common import stored

#: No stage can be told in SQL: they hash n-grams, learn vectors, and encode bytes.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.known_documents(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing sources to target weights", mixing_to_weights),
    ("byte-level BPE encoding and decoding", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: digests of the encoded texts, one row per document and copy."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
