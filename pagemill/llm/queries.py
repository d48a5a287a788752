"""The registered queries of the training-data operators, and their SQL.

Each query applies its operator to a whole table with production settings; the
digest columns of its contract are derived here from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ctw, dac, decontam, histogram, licenses, linededup, negatives, packing, pii, quality, simhash, toxicity
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digest, licence and notices of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest of the base spans, and all spans of every document."""
    found = pii.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix sums over the lengths of all documents."""
    return histogram.token_counts(table(spark, sf_dir, "documents"))


def op6_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and context-tree score of every document."""
    return ctw.score(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document, read back from its token files."""
    return dac.round_trip(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of at most 4096 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base_failed and kept of every document, and its quality."""
    found = quality.score(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *quality.COUNTS, "base_failed", "kept", "quality")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and counts of the two tokenizations of every document."""
    return align.align(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive."""
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and digest of what stays of every document."""
    found = linededup.drop_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_license_scan": op2_license_scan,
    "op3_pii": op3_pii,
    "op4_token_counts": op4_token_counts,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_context_tree": op6_context_tree,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_token_files": op9_token_files,
    "op10_quality_rules": op10_quality_rules,
    "op11_token_alignment": op11_token_alignment,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_line_dedup": op13_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": licenses.scan_sql(),
    "op12_hard_negatives": negatives.hard_negatives_sql(),
    "op13_line_dedup": linededup.line_dedup_sql(),
}
