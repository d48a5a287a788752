"""Plumbing shared by the training-data operators: tables, durable scratch, Arrow.

Scratch data lives under ``spark.checkpoint.dir`` (shared by driver and all
executors), never on a machine's own disk, so a lost executor costs a retry only.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: texts are large, so batches stay a few MB.
ARROW_ROWS = 1000
#: Bytes of an Arrow batch, as far as its rows can be parted.
ARROW_BYTES = 4 << 20
#: Rows that Spark's Parquet reader holds at a time, for the same reason.
READ_ROWS = 512
#: Bytes of a row group of a scratch table: its writer holds as many.
GROUP_BYTES = 16 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on; AQE splits skewed joins at run time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone (a null text is empty); other columns are ignored."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path in the shared folder; a temporary folder only where none is set and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='pagemill-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/pagemill/{uuid.uuid4().hex}"


def durable(df: DataFrame, **options: str) -> DataFrame:
    """Write to the shared folder, with the writer's ``options``, and read back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    df.write.options(**{"parquet.block.size": str(GROUP_BYTES)} | options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that one task writes or reads at least.
SMALL_ROWS = 200_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of at most ``rows`` small rows in as few tasks as that many need: no file for each of many empty parts."""
    return df.coalesce(max(1, -(-rows // SMALL_ROWS)))


_held: dict[Hashable, Any] = {}


def only(key: Hashable, make: Callable[[], Any]) -> Any:
    """``make()``, remembered by a Python worker until it is asked for another key.

    Workers outlive their tasks and go from one operator to the next; each keeps one
    large object (encoder, index, tables) at a time, so what it holds does not add up.
    """
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Give back what ``only`` remembers, and free memory to the system."""
    if not _held:
        return
    _held.clear()
    gc.collect()
    trim()


def trim() -> None:
    """Give memory that is free in this worker to the system; the allocators keep tens of MB of it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass
