"""A corpus from raw documents to packed sequences, stage by stage.

Each stage works on all that its predecessor kept and is written and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigmatide.llm import queries
from sigmatide.llm.decontaminate import drop_contaminated
from sigmatide.llm.exact_dedup import drop_exact_copies
from sigmatide.llm.packing import pack_documents
from sigmatide.llm.quality import drop_rejected
from sigmatide.llm.simhash import drop_near_copies
from sigmatide.session import staged


def quality_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier keeps; it is fitted on the labels of these documents."""
    return drop_rejected(docs, queries.table(spark, folder, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return drop_near_copies(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return drop_contaminated(docs, queries.table(spark, folder, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of the remaining documents with their places in sequences."""
    return pack_documents(docs, queries.PACK_TOKENIZER)[1]


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

# Trained models, fingerprints and tokenizers have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, f"stage-{i}")
    return docs
