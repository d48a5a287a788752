"""Small frame operations that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import kept


def one_each(df: DataFrame, *keys: str) -> DataFrame:
    """One row of each key, the least by its other columns: the same row every time, found by a partial aggregation.

    Nulls come first in the order of a column, and null keys are one key.
    """
    rest = [c for c in df.columns if c not in keys]
    least = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__least")) if rest else df.distinct()
    return least.select(*(F.col(c) if c in keys else F.col("__least")[c].alias(c) for c in df.columns))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with its rows counted from 0 in the order they lie in, without a gap; no row moves.

    Rows are numbered in each partition first and written; the driver adds up one count
    a partition.
    """
    marked = kept(df.withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, 33)
    counts = {r.part: r["count"] for r in marked.groupBy(part.alias("part")).count().collect()}
    starts, total = [], 0
    for p in sorted(counts):
        starts.append((p, total))
        total += counts[p]
    offsets = df.sparkSession.createDataFrame(starts, "__part long, __start long")  # a row a partition
    made = marked.join(F.broadcast(offsets), part == F.col("__part"))
    return made.withColumn(name, F.col("__start") + F.col(name).bitwiseAND((1 << 33) - 1)).drop("__part", "__start")
