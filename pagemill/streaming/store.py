"""Tables that streams write into by key: small delta files, merged when they are read.

A batch writes its own rows and then, in one file that must not be there yet, what the
table consists of: a base and the deltas after it. Until that file is there, the
version before it counts, so a crash at any step leaves the last table. Once the deltas
are as large as the base, they are merged into a new one; many small ones are merged with each
other first. So a batch writes about as much as it holds, and the table takes no
more than twice its size, besides what the version before still needs.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import folders

#: Deltas that are read one by one; more are merged with each other.
MOST_DELTAS = 16
#: Versions whose files stay, for readers that have begun on them.
KEPT = 2
Merge = Callable[[DataFrame, DataFrame], DataFrame]


def _plans(spark: SparkSession, table: str) -> list[dict]:
    """What each complete version consists of, oldest first."""
    texts = ((n, folders.read_text(spark, f"{path}/table.json")) for n, path in folders.inside(spark, table, "v"))
    return [json.loads(t) | {"version": n} for n, t in texts if t is not None]


def _read(spark: SparkSession, table: str, parts: list[dict], keys: list[str], sums: list[str] | None) -> DataFrame:
    """The parts as one table: the last row of a key, or its sums."""
    frames = [spark.read.parquet(f"{table}/{p['path']}").withColumn("__batch", F.lit(p["batch"])) for p in parts]
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f, allowMissingColumns=True)
    if len(frames) == 1:
        return every.drop("__batch")
    if sums:
        return every.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))
    names = [c for c in every.columns if c != "__batch"]
    rest = [c for c in names if c not in keys]
    if not rest:
        return every.select(*keys).distinct()
    last = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("__last"))
    return last.select(*(F.col(c) if c in keys else F.col("__last")[c].alias(c) for c in names))


def upserted(spark: SparkSession, table: str, below: int | None = None) -> DataFrame | None:
    """The table as it stands, or as it stood before batch ``below`` if that version is kept; None of nothing."""
    plans = [p for p in _plans(spark, table) if below is None or p["batch"] < below]
    if not plans:
        return None
    p = plans[-1]
    return _read(spark, table, [p["base"], *p["deltas"]], p["keys"], p["sums"])


def _committed(spark: SparkSession, table: str, keys: list[str], sums: list[str] | None, batch: DataFrame, number: int, merge: Merge | None) -> None:
    plans = _plans(spark, table)
    old = plans[-1] if plans else None
    if old and old["batch"] > number:
        raise ValueError(f"{table} holds batches after {number}: another stream has written it")
    if (old and old["batch"] == number) or batch.isEmpty():
        return
    version = old["version"] + 1 if old else 0
    name = f"v={version:08d}"
    folders.remove(spark, f"{table}/{name}")  # what a crash has left

    def written(df: DataFrame, part: str) -> dict:
        df.write.parquet(f"{table}/{name}/{part}")
        return {"path": f"{name}/{part}", "batch": number, "bytes": folders.size(spark, f"{table}/{name}/{part}")}

    if old is None:
        base, deltas = written(batch, "base"), []
    elif merge:
        base, deltas = written(merge(_read(spark, table, [old["base"]], keys, sums), batch), "base"), []
    else:
        base, deltas = old["base"], [*old["deltas"], written(batch, "delta")]
        if sum(d["bytes"] for d in deltas) >= base["bytes"]:
            base, deltas = written(_read(spark, table, [base, *deltas], keys, sums), "base"), []
        elif len(deltas) > MOST_DELTAS:
            deltas = [written(_read(spark, table, deltas, keys, sums), "deltas")]
    folders.put_text(spark, f"{table}/{name}/table.json", json.dumps({"batch": number, "keys": keys, "sums": sums, "base": base, "deltas": deltas}))
    _tidied(spark, table)


def _tidied(spark: SparkSession, table: str) -> None:
    """Remove what none of the last versions needs."""
    last = _plans(spark, table)[-KEPT:]
    needed = {p["path"] for x in last for p in [x["base"], *x["deltas"]]}
    for n, path in folders.inside(spark, table, "v"):
        if n > last[-1]["version"]:
            continue
        held = {p.split("/")[0] for p in needed}
        if f"v={n:08d}" not in held and all(x["version"] != n for x in last):
            folders.remove(spark, path)
            continue
        for part in ("base", "delta", "deltas"):
            if f"v={n:08d}/{part}" not in needed:
                folders.remove(spark, f"{path}/{part}")


def upsert_into(table: str, keys: list[str], merge: Merge | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for update mode: each batch replaces the rows of its keys in a Parquet table.

    ``merge(old, fresh)`` says what a table becomes instead; it is applied, and the table
    written, batch by batch. A batch that runs again changes nothing, an empty one
    neither. Where a later batch is there, the stream began anew over an old table, and
    the batch fails instead of hiding rows. Of rows of one key in a batch any one stays.
    """
    return lambda batch, number: _committed(batch.sparkSession, table, keys, None, batch, number, merge)


def sums_into(table: str, keys: list[str], sums: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that adds each batch's sums to those stored, once however often a batch runs."""
    added = lambda batch: batch.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))
    return lambda batch, number: _committed(batch.sparkSession, table, keys, sums, added(batch), number, None)


def cleanup(spark: SparkSession, table: str, expires: str, now, key: str) -> int:
    """Take rows whose ``expires`` has passed out of a table of ``upsert_into`` or ``sums_into``; how many went.

    A version of its own, with the same batch number, so a stream goes on after it; run
    again, it finds nothing. Null ``expires`` never passes.
    """
    plans = _plans(spark, table)
    if not plans:
        return 0
    old = plans[-1]
    rows = _read(spark, table, [old["base"], *old["deltas"]], old["keys"], old["sums"])
    gone = F.coalesce(F.col(expires) <= now, F.lit(False))
    n = rows.where(gone).select(key).count()
    if n:
        name = f"v={old['version'] + 1:08d}"
        folders.remove(spark, f"{table}/{name}")
        rows.where(~gone).write.parquet(f"{table}/{name}/base")
        base = {"path": f"{name}/base", "batch": old["batch"], "bytes": folders.size(spark, f"{table}/{name}/base")}
        folders.put_text(spark, f"{table}/{name}/table.json", json.dumps({k: old[k] for k in ("batch", "keys", "sums")} | {"base": base, "deltas": [], "expired": n}))
        _tidied(spark, table)
    return n
