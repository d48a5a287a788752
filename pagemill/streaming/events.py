"""Structured Streaming forms of the event operators: their results equal the batch ones."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .store import sums_into, upsert_into, upserted

__all__ = ["anchored", "cancel", "cancellable", "creates", "first_of_key", "hourly", "job_events", "latency_window", "live_values", "minute_counts", "read_events", "run_to_end", "status_changes", "sums_into", "upsert_into", "upserted"]


def read_events(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """New Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def hourly(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Counts, errors and sums by hour and keys; late rows count until the watermark passes."""
    made = events.withWatermark("ts", late)
    grouped = made.groupBy(F.window("ts", "1 hour").alias("w"), *keys)
    out = grouped.agg(F.count("*").alias("request_count"), F.count_if(F.col("outcome") != "success").alias("error_count"), F.sum("duration_ms").alias("duration_ms_sum"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd'T'HH").alias("hour"), *keys, "request_count", "error_count", "duration_ms_sum")


def minute_counts(requests: DataFrame, keys: list[str], seconds: int = 60, late: str = "5 seconds") -> DataFrame:
    """Hits of each key in its aligned window."""
    made = requests.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds").alias("w"), *keys).agg(F.count("*").alias("hits"))
    return made.select(F.col("w.start").alias("bucket"), *keys, "hits")


def first_of_key(creates: DataFrame, key: str, late: str = "24 hours") -> DataFrame:
    """The first create of each idempotency key within the time keys are remembered."""
    return creates.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def latency_window(events: DataFrame, key: str, value: str = "duration_ms", at: str = "ts", most: int = 1024) -> DataFrame:
    """(key, count, avg, p50, p95) of each key's last ``most`` samples, after every batch; the samples are the state."""
    kinds = dict(events.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(at, kind="stable")
        fresh = [max(0, math.floor(x + 0.5)) for x in rows[value].fillna(0)]
        held = [*(state.get[0] if state.exists else []), *fresh][-most:]
        state.update((held,))
        rank = lambda p: sorted(held)[math.ceil(p * len(held)) - 1]
        yield pd.DataFrame([(k[0], len(held), math.floor(sum(held) / len(held) * 100 + 0.5) / 100, rank(0.5), rank(0.95))], columns=[key, "count", "avg", "p50", "p95"])

    return events.groupBy(key).applyInPandasWithState(step, f"`{key}` {kinds[key]}, count long, avg double, p50 long, p95 long", "samples array<long>", "update", GroupStateTimeout.NoTimeout)


def creates(requests: DataFrame, key: str, payload: str, at: str = "ts", hours: int = 24) -> DataFrame:
    """(key, request_id, outcome): the first request of a key within ``hours`` is created, later ones are replayed or, of another payload, in conflict."""
    kinds, life = dict(requests.dtypes), hours * 3_600_000

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows, outcomes = pd.concat(list(batches)).sort_values([at, "request_id"], kind="stable"), []
        first, end = state.get if state.exists else (None, -1)
        for t, p in zip(rows[at].astype("datetime64[ms]").astype("int64"), rows[payload], strict=True):
            if t >= end:
                first, end = p, int(t) + life
                outcomes.append("created")
            else:
                outcomes.append("replayed" if p == first else "conflict")
        state.update((first, end))
        if end > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(end)
        yield pd.DataFrame({key: [k[0]] * len(rows), "request_id": rows["request_id"].to_numpy(), "outcome": outcomes})

    made = requests.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, "1 hour")
    return made.groupBy(key).applyInPandasWithState(step, f"`{key}` {kinds[key]}, request_id {kinds['request_id']}, outcome string", f"first {kinds[payload]}, until long", "append", GroupStateTimeout.EventTimeTimeout)


def anchored(requests: DataFrame, key: str, limit: int, seconds: int) -> DataFrame:
    """(key, event_id, hit, blocked): windows that begin at a first hit, kept as state and dropped when they have passed.

    Events of one batch are taken in order of time; state expires by event time.
    """
    size = seconds * 1000
    kinds = dict(requests.dtypes)
    schema = f"`{key}` {kinds[key]}, event_id {kinds['event_id']}, hit long, blocked boolean"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, end = state.get if state.exists else (0, -1)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        hits = []
        for t in rows["ts"].astype("datetime64[ms]").astype("int64"):
            if t >= end:
                n, end = 0, int(t) + size
            n += 1
            hits.append(n)
        state.update((n, end))
        if end > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(end)
        yield pd.DataFrame({key: [k[0]] * len(rows), "event_id": rows["event_id"].to_numpy(), "hit": hits, "blocked": [h > limit for h in hits]})

    made = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{seconds} seconds")
    return made.groupBy(key).applyInPandasWithState(step, schema, "n long, end long", "append", GroupStateTimeout.EventTimeTimeout)


TERMINAL = ("succeeded", "failed", "canceled")


def status_changes(history: DataFrame, key: str, at: str = "ts", terminal: tuple[str, ...] = (), seconds: int | None = None, late: str = "1 hour") -> DataFrame:
    """(key, ts, status) whenever a key's status differs from the last one seen.

    A key's changes end after a status of ``terminal``, or ``seconds`` after its first.
    The state of a key that has ended is dropped once the watermark, which is ``late``
    behind, has passed its end, so what is kept follows the keys that live; rows behind
    the watermark are too late to count. Without either, a key never ends.
    """
    kinds = dict(history.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(at, kind="stable")
        last, began, ended, until = state.get if state.exists else (None, None, False, None)
        keep = []
        for t, s in zip(rows[at].astype("datetime64[ms]").astype("int64"), rows["status"], strict=True):
            began = int(t) if began is None else began
            ended = ended or (seconds is not None and t > began + seconds * 1000)
            keep.append(not ended and s != last)
            ended = ended or s in terminal
            until = int(t) if s in terminal and until is None else until
            last = s
        state.update((last, began, ended, until))
        ends = until if until is not None else began + seconds * 1000 + 1 if seconds is not None else None
        if ends is not None:
            state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield rows[keep][[key, at, "status"]]

    made = history.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return made.groupBy(key).applyInPandasWithState(step, f"`{key}` {kinds[key]}, `{at}` timestamp, status string", "status string, began long, ended boolean, until long", "append", GroupStateTimeout.EventTimeTimeout)


def job_events(history: DataFrame, key: str, at: str = "ts", seconds: int = 60, late: str = "1 second") -> DataFrame:
    """(key, ts, event, status) for those who watch jobs: ``status`` for each change, ``done`` at a terminal status, or
    ``timeout`` when the watermark passes ``seconds`` after a job's first row without one. After either a job is silent,
    until the watermark has passed its time and its state is dropped."""
    kinds = dict(history.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, began, ended = state.get if state.exists else (None, None, False)
        out = []
        if state.hasTimedOut:
            if not ended:
                out.append((k[0], pd.Timestamp(began + seconds * 1000, unit="ms"), "timeout", last))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(at, kind="stable")
            for t, s in zip(rows[at].astype("datetime64[ms]"), rows["status"], strict=True):
                ms = int(t.value // 10**6)
                began = ms if began is None else began
                if ended or ms > began + seconds * 1000:
                    continue
                if s != last:
                    out.append((k[0], t, "status", s))
                if s in TERMINAL:
                    out.append((k[0], t, "done", s))
                    ended = True
                last = s
            state.update((last, began, ended))
            state.setTimeoutTimestamp(max(began + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, at, "event", "status"])

    made = history.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return made.groupBy(key).applyInPandasWithState(step, f"`{key}` {kinds[key]}, `{at}` timestamp, event string, status string", "status string, began long, ended boolean", "append", GroupStateTimeout.EventTimeTimeout)


def live_values(updates: DataFrame, key: str, value: str, at: str = "ts", seconds: int = 15, late: str = "1 second") -> DataFrame:
    """(key, ts, value, hit): each request's value, taken from the state while that lives and from the request beyond.

    What a request brings is kept for ``seconds`` from when it was taken in (15 for hot
    content, 10 for sessions, 120 for retry tokens) and dropped after it.
    """
    kinds = dict(updates.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, until = state.get if state.exists else (None, -1)
        out = []
        rows = pd.concat(list(batches)).sort_values([at, value], kind="stable")
        for t, v in zip(rows[at].astype("datetime64[ms]"), rows[value], strict=True):
            ms = int(t.value // 10**6)
            hit = ms < until
            if not hit:
                held, until = v, ms + seconds * 1000
            out.append((k[0], t, held, hit))
        state.update((held, until))
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, at, value, "hit"])

    made = updates.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return made.groupBy(key).applyInPandasWithState(step, f"`{key}` {kinds[key]}, `{at}` timestamp, `{value}` {kinds[value]}, hit boolean", f"held {kinds[value]}, until long", "append", GroupStateTimeout.EventTimeTimeout)


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs started inside carry ``tag``; ``cancel`` ends them wherever they run."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """End the jobs of a tag, whichever thread started them."""
    spark.sparkContext.cancelJobsWithTag(tag)


def run_to_end(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """All that is there now, through a memory sink: for small results and tests."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
