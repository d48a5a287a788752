"""Folds in blocks give what a fold row by row gives, however the rows are cut."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import jobs, ratelimit
from pagemill.plans import details  # noqa: F401
from pagemill.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import compare


@pytest.fixture
def cut(spark):
    """Many small partitions, whatever their size."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def anchored(rows, size):
    out, state = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        n, end = state.get(k, (0, -1 << 62))
        n, end = (1, t + size) if t >= end else (n + 1, end)
        state[k] = n, end
        out[i] = n, end
    return out


@pytest.mark.parametrize("gap", [3, 40, 400])
def test_anchored_windows_of_a_key_that_is_never_silent(spark, cut, gap):
    r = random.Random(gap)
    rows, t = [], 0
    for i in range(4000):  # one key holds most rows; with a gap of 3 a window spans several blocks
        t += r.randrange(gap)
        rows.append(("hot" if r.random() < 0.8 else r.choice(["a", "b", None]), t, i))
    df = spark.createDataFrame(rows, "key string, s long, event_id long").withColumn("ts", F.timestamp_seconds("s"))
    got = {x.event_id: (x.hit, x.end) for x in ratelimit.anchored_window(df, "key", "ts", 2, 600).select("event_id", "hit", F.unix_seconds("reset_at").alias("end")).collect()}
    assert got == anchored(rows, 600)


def test_equal_times_and_no_rows(spark, cut):
    rows = [("k", 5, i) for i in range(500)]
    df = spark.createDataFrame(rows, "key string, s long, event_id long").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(x.hit for x in ratelimit.anchored_window(df, "key", "ts", 2, 1).collect()) == list(range(1, 501))
    assert ratelimit.anchored_window(df.where("false"), "key", "ts", 2, 1).collect() == []


def plain_pacing(rows, jitters, base=1000, most=30_000):
    out, delays = [], {}
    for (d, s, ok), j in sorted(zip(rows, jitters, strict=True), key=lambda x: (str(x[0][0]), x[0][1], x[0][2])):
        delay = delays.get(d, base)
        delay = max(base, int(delay * 0.75)) if ok else min(most, int(delay * 2 * j))
        delays[d] = delay
        out.append((d, s, ok, delay, min(base, delay) if ok else delay))
    return sorted(out, key=repr)


@pytest.mark.parametrize("share", [0.5, 0.72, 0.97])
def test_pacing_of_a_large_domain(spark, cut, share):
    import hashlib

    r = random.Random(1)
    rows = [(r.choice(["big"] * 8 + ["x", None]), i // 2, r.random() < share) for i in range(3000)]
    jitter = [0.75 + int(hashlib.md5(":".join(x for x in ("7", d, str(s)) if x is not None).encode()).hexdigest()[:8], 16) / 2**33 for d, s, _ in rows]
    df = spark.createDataFrame(rows, "domain string, seq long, success boolean")
    assert sorted((tuple(x) for x in jobs.paced(df, seed=7).collect()), key=repr) == plain_pacing(rows, jitter)


@pytest.mark.parametrize("name", ["job_pacing", "rate_limit_anchored"])
def test_queries_cut_into_blocks(spark, sf, cut, name):
    compare(spark, sf, QUERIES[name], ORACLE_SQL[name])
