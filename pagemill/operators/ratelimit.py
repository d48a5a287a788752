"""Rate limits: aligned windows by ranking, and windows that begin with a first hit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import Fold, State, folded


def fixed_window(requests: DataFrame, keys: list[str], ts: str, limit, seconds: int = 60, tie: str = "event_id") -> DataFrame:
    """Each request with its place in its key's aligned window: hit, limit, exceeded, remaining, retry_after_s."""
    epoch = F.unix_micros(F.col(ts).cast("timestamp"))
    size = seconds * 1_000_000
    bucket = F.floor(epoch / size)
    hit = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(ts, tie))
    left = F.ceil(((F.col("bucket") + 1) * size - epoch) / 1_000_000)
    most = limit if not isinstance(limit, int) else F.lit(limit)
    made = requests.withColumn("bucket", bucket).withColumn("hit", hit).withColumn("limit", most)
    return made.withColumns({"exceeded": F.col("hit") > F.col("limit"), "remaining": F.greatest(F.lit(0), F.col("limit") - F.col("hit")), "retry_after_s": F.greatest(F.lit(1), left)})


def _anchored(size: int) -> Fold:
    """Windows of ``size`` that begin at a hit; the state is (end of the window, hits in it)."""

    def summed(rows: pd.DataFrame) -> list[np.ndarray]:
        """For hits that a window may begin with in this block: its last window's end and hits, if one does.

        A hit points at the first one after its window; pointers are doubled until all
        show the last window of the block. Of neighbours with one answer the last is kept.
        """
        t = rows["t"].to_numpy()
        n, at = len(t), np.arange(len(t))
        after = np.searchsorted(t, t + size)
        last = np.where(after < n, np.minimum(after, n - 1), at)
        while True:
            far = last[last]
            if (far == last).all():
                break
            last = far
        # a window from before ends within ``size`` of the block's first hit
        entry = np.arange(min(n, int(np.searchsorted(t, t[0] + size)) + 1))
        entry = entry[np.searchsorted(t, t[entry], side="left") == entry]  # of equal times the first
        stay = np.r_[last[entry[1:]] != last[entry[:-1]], True]
        entry = entry[stay]
        return [t[entry], t[last[entry]] + size, n - last[entry]]

    def passed(state: State, arrays: list[np.ndarray], n: int) -> State:
        end, hits = state
        at, ends, counts = arrays
        i = int(np.searchsorted(at, end))
        return (int(ends[i]), int(counts[i])) if i < len(at) else (end, hits + n)

    def stepped(state: State, rows: pd.DataFrame) -> tuple[State, dict[str, np.ndarray]]:
        t = rows["t"].to_numpy()
        (end, hits), i = state, 0
        hit, ends = np.empty(len(t), np.int64), np.empty(len(t), np.int64)
        while i < len(t):
            if t[i] >= end:
                end, hits = int(t[i]) + size, 0
            j = int(np.searchsorted(t, end))
            hit[i:j], ends[i:j] = np.arange(hits + 1, hits + 1 + j - i), end
            hits, i = hits + j - i, j
        return (end, hits), {"hit": hit, "end": ends}

    return Fold((np.iinfo(np.int64).min, 0), ["t"], summed, passed, stepped, "hit long, end long")


def anchored_window(requests: DataFrame, key: str, ts: str, limit: int, seconds: int, tie: str = "event_id") -> DataFrame:
    """(key, tie, ts, hit, blocked, reset_at): a counter whose window starts at its first hit and restarts at the first hit once it has passed.

    Where a window starts depends on where the last one did. Keys are folded in blocks
    (see ``folds``), so one that is never silent is split like any other. Requests of
    null time don't count; null keys are one key.
    """
    rows = requests.where(F.col(ts).isNotNull()).select(key, tie, F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    made = folded(rows, key, ["t", tie], _anchored(seconds * 1_000_000))
    return made.select(key, tie, F.timestamp_micros("t").alias(ts), "hit", (F.col("hit") > limit).alias("blocked"), F.timestamp_micros("end").alias("reset_at"))


def peek(counters: DataFrame, now) -> DataFrame:
    """Counters that still count."""
    return counters.where(F.col("expires_at") > now)
