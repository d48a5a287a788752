"""Training-data pipeline: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of documents,
whatever others there are and whatever their names. A null text counts as empty, repeated
rows are judged each by itself, null ids are ids like others, and an empty table gives an
empty one; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import decontam, packing, pii, quality, simhash
from pagemill.llm.common import durable, table, tune


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the base rules or the estimated quality reject; null and empty texts go."""
    tune(spark)
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of exact and near copies (five-word shingles, 0.8 alike or more): the least id, null ids last; of equal rows one."""
    tune(spark)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item; null and empty texts and items match nothing."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind, and count their characters anew; a null text stays null."""
    tune(spark)
    return pii.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens; a null or empty text is its end mark."""
    tune(spark)
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: The stages train models and tokenize, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = durable(docs)
    return docs
