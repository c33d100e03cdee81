"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing, packing; each stage reads what the one before kept, from Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codecloom.llm import exact_dedup as exact
from codecloom.llm import mixing, near_dedup, packing, quality
from codecloom.llm.common import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents: doc_id, start, length, doc_tokens, ids_crc32, sequence_id, offset, ids."""
    return packing.pack(docs).withColumnsRenamed({"id": "doc_id", "crc": "ids_crc32"})


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_deduplication),
    ("source_mixing", source_mixing),
    ("packing", sequence_packing),
]

#: SQL cannot express near-duplicate components, the fitted thresholds and packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's rows written as Parquet and reread by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = scratch.write(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(docs)
        docs = out
    return docs
