"""Exact token counts for every context limit from one histogram of lengths.

Documents are aggregated by encoded length first (a partial count in each task), so
all later work is on at most one row a distinct length. Suffix sums over the lengths
then answer, for any limit, how many documents are longer, the total of tokens that
remain when each document is cut there, and exact quantiles. The sums go in two
levels, blocks of lengths and lengths in a block, so no task sees all lengths: a block
is about as long as there are blocks, by the largest length that occurs.

Defined results: a null text is empty, of length zero (plus the end id where one is
asked for); repeated rows count as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, texts
from .tokens import BYTE, encoder, vocabulary

def lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(length): the number of ids of every document's whole text."""
    path = path or vocabulary(BYTE)

    def run(batches):
        encode = encoder(path)
        for b in batches:
            ids = encode(b.column(0).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids)))], names=["length"])

    return texts(docs).select("text").mapInArrow(run, "length long")


def histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(length, n_docs)"""
    return lengths(docs, path).groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """Per length: n_docs; of documents this long or longer docs_from and tokens_from;
    total_docs and total_tokens; truncated_tokens, what is left of the corpus when
    every document is cut to this length; and quantile, the share of documents at
    most this long."""
    block = math.isqrt(counts.agg(F.max("length")).first()[0] or 0) + 1
    counts = counts.withColumn("block", F.expr(f"length div {block}")).withColumn("tokens", F.col("length") * F.col("n_docs"))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    after = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    later = blocks.select("block", zero(F.sum("bd").over(after)).alias("later_docs"), zero(F.sum("bt").over(after)).alias("later_tokens"), F.sum("bd").over(every).alias("total_docs"), F.sum("bt").over(every).alias("total_tokens"))
    here = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.withColumns({"in_docs": F.sum("n_docs").over(here), "in_tokens": F.sum("tokens").over(here)}).join(later, "block")
    docs_from, tokens_from = F.col("in_docs") + F.col("later_docs"), F.col("in_tokens") + F.col("later_tokens")
    return summed.select(
        "length",
        "n_docs",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        "total_docs",
        "total_tokens",
        (F.col("total_tokens") - tokens_from + docs_from * F.col("length")).alias("truncated_tokens"),
        ((F.col("total_docs") - docs_from + F.col("n_docs")) / F.col("total_docs")).alias("quantile"),
    )


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The suffix sums of the corpus; its histogram is written once and read twice."""
    return suffix_sums(durable(histogram(docs, path)))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, truncated_tokens, docs_over, total_tokens) for any limits, from the suffix sums."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(x,) for x in limits], "context_limit long")
    over = sums.join(F.broadcast(asked), F.col("length") > F.col("context_limit"))  # the few limits asked for are the small side
    first = over.groupBy("context_limit").agg(F.max("docs_from").alias("docs_over"), F.max("tokens_from").alias("tokens_over"))
    total = sums.agg(F.max("total_tokens").alias("total_tokens"))
    joined = asked.join(first, "context_limit", "left").join(F.broadcast(total))  # one row
    docs_over = F.coalesce("docs_over", F.lit(0))
    return joined.select("context_limit", (F.col("total_tokens") - F.coalesce("tokens_over", F.lit(0)) + docs_over * F.col("context_limit")).alias("truncated_tokens"), docs_over.alias("docs_over"), "total_tokens")


def quantile(sums: DataFrame, share: float) -> int | None:
    """The least length that at least ``share`` of the documents do not exceed."""
    return sums.where(F.col("quantile") >= share).agg(F.min("length")).first()[0]
