import pytest
from pyspark.sql import functions as F

from pagemill import folders
from pagemill.operators import events, jobs, ratelimit
from pagemill.plans import catalog
from pagemill.streaming import events as streaming
from pagemill.streaming import store


@pytest.fixture(scope="module")
def log(spark, sf, tmp_path_factory):
    """The request log as files in order of time."""
    folder = str(tmp_path_factory.mktemp("log") / "files")
    df = catalog.log(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartitionByRange(3, "ts").sortWithinPartitions("ts", "event_id").write.parquet(folder)
    return folder, spark.read.parquet(folder)


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_hourly_stream_equals_batch(spark, log):
    folder, batch = log
    stream = streaming.hourly(streaming.read_events(spark, folder, batch.schema, 10), ["event_type"])
    got = streaming.run_to_end(stream, "hourly", "complete")
    want = batch.groupBy(F.date_format("ts", "yyyy-MM-dd'T'HH").alias("hour"), "event_type").agg(F.count("*").alias("request_count"), F.count_if(F.col("outcome") != "success").alias("error_count"), F.sum("duration_ms").alias("duration_ms_sum"))
    assert rows(got) == rows(want)


def test_upsert_sink(spark, log, tmp_path):
    folder, batch = log
    table = str(tmp_path / "t")

    def run(checkpoint, sink):
        stream = streaming.read_events(spark, folder, batch.schema).groupBy("event_type").agg(F.count("*").alias("n"))
        stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()

    run("c", streaming.upsert_into(table, ["event_type"]))
    want = rows(batch.groupBy("event_type").agg(F.count("*").alias("n")))
    assert rows(streaming.upserted(spark, table)) == want
    with pytest.raises(Exception, match="another stream"):
        run("other", streaming.upsert_into(table, ["event_type"]))  # a new checkpoint begins at 0 over the old table
    assert rows(streaming.upserted(spark, table)) == want


def test_upserts_replace_only_their_keys(spark, tmp_path):
    table, made = str(tmp_path / "t"), lambda *r: spark.createDataFrame(list(r), "k string, n long")
    assert streaming.upserted(spark, table) is None
    write, add = streaming.upsert_into(table, ["k"]), streaming.sums_into(str(tmp_path / "s"), ["k"], ["n"])
    for number, batch in enumerate([made(("a", 1), ("b", 1)), made(("b", 2), ("c", 2)), made(("d", 3)).limit(0), made(("a", 5))]):
        for _ in range(2):  # a batch that runs again leaves the same
            write(batch, number)
            add(batch, number)
    assert rows(streaming.upserted(spark, table)) == rows(made(("a", 5), ("b", 2), ("c", 2)))
    assert rows(streaming.upserted(spark, str(tmp_path / "s"))) == rows(made(("a", 6), ("b", 3), ("c", 2)))
    assert rows(streaming.upserted(spark, table, below=3)) == rows(made(("a", 1), ("b", 2), ("c", 2)))


def test_a_batch_writes_its_own_size_and_old_files_go(spark, tmp_path):
    """Small batches over a large table: each writes little, storage stays near the table, and all keys are right."""
    table, n = str(tmp_path / "t"), 20_000
    big = spark.range(n).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
    write = streaming.upsert_into(table, ["k"])
    write(big, 0)
    whole = folders.size(spark, table)
    want = dict.fromkeys(range(n), 0)
    for number in range(1, 24):
        before = {p for _, p in folders.inside(spark, table, "v")}
        fresh = big.where(F.col("k") % 997 == number).withColumn("n", F.lit(number).cast("long"))
        write(fresh, number)
        want |= {k: number for k in range(n) if k % 997 == number}
        added = sum(folders.size(spark, p) for _, p in folders.inside(spark, table, "v") if p not in before)
        assert added < whole / 4
        assert folders.size(spark, table) < 2 * whole
    assert {r.k: r.n for r in streaming.upserted(spark, table).collect()} == want
    assert len(store._plans(spark, table)[-1]["deltas"]) <= store.MOST_DELTAS
    write(big.withColumn("n", F.lit(99).cast("long")), 30)  # as large as the table: merged into a new base
    write(big.limit(1).withColumn("n", F.lit(100).cast("long")), 31)
    write(big.limit(1).withColumn("n", F.lit(101).cast("long")), 32)
    assert folders.size(spark, table) < 2 * whole
    assert streaming.upserted(spark, table).groupBy("n").count().count() == 2


@pytest.mark.parametrize("step", ["put_text", "size"])
def test_a_crash_leaves_the_last_table(spark, tmp_path, monkeypatch, step):
    table, made = str(tmp_path / "t"), lambda *r: spark.createDataFrame(list(r), "k string, n long")
    write = streaming.sums_into(table, ["k"], ["n"])
    write(made(("a", 1), ("b", 1)), 0)

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store.folders, step, crash)
        with pytest.raises(OSError, match="lost"):
            write(made(("a", 5)), 1)
    assert rows(streaming.upserted(spark, table)) == rows(made(("a", 1), ("b", 1)))
    write(made(("a", 5)), 1)
    assert rows(streaming.upserted(spark, table)) == rows(made(("a", 6), ("b", 1)))


def test_cleanup_removes_once(spark, tmp_path):
    table = str(tmp_path / "t")
    write = streaming.upsert_into(table, ["k"])
    made = lambda *r: spark.createDataFrame(list(r), "k string, until long")
    write(made(("a", 5), ("b", 50), ("c", None)), 0)
    write(made(("d", 6)), 1)
    assert [store.cleanup(spark, table, "until", F.lit(t), "k") for t in (6, 6, 60)] == [2, 0, 1]
    assert rows(streaming.upserted(spark, table)) == rows(made(("c", None)))
    write(made(("a", 99)), 2)
    assert rows(streaming.upserted(spark, table)) == rows(made(("c", None), ("a", 99)))


def stated(spark, checkpoint):
    """Keys in the state store."""
    return spark.read.format("statestore").load(checkpoint).count()


def test_jobs_end_and_leave_the_state(spark, tmp_path):
    df = lambda *r: spark.createDataFrame(list(r), "job string, s long, status string").select("job", F.timestamp_seconds(F.col("s") + 10**6).alias("ts"), "status").coalesce(1)
    folder, point = str(tmp_path / "h"), str(tmp_path / "c")
    first = df(("j", 0, "queued"), ("j", 1, "running"), ("k", 0, "queued"), ("j", 2, "running"), ("j", 3, "succeeded"), ("j", 4, "queued"))
    for b in (first, df(("z", 90, "queued"))):
        b.write.mode("append").parquet(folder)
    got = streaming.run_to_end(streaming.job_events(streaming.read_events(spark, folder, first.schema), "job"), "job_events", checkpoint=point)
    told = sorted((r.job, r.event, r.status) for r in got.collect())
    assert told == [("j", "done", "succeeded"), ("j", "status", "queued"), ("j", "status", "running"), ("j", "status", "succeeded"), ("k", "status", "queued"), ("k", "timeout", "queued"), ("z", "status", "queued")]
    assert stated(spark, point) == 1  # only z is left


def test_values_live_for_their_time(spark, tmp_path):
    df = lambda *r: spark.createDataFrame(list(r), "k string, s long, v string").select("k", F.timestamp_seconds(F.col("s") + 10**6).alias("ts"), "v").coalesce(1)
    folder, point = str(tmp_path / "h"), str(tmp_path / "c")
    first = df(("a", 0, "x"), ("a", 14, "y"), ("a", 15, "z"), ("b", 0, "q"))
    for b in (first, df(("c", 100, "w"))):
        b.write.mode("append").parquet(folder)
    got = streaming.run_to_end(streaming.live_values(streaming.read_events(spark, folder, first.schema), "k", "v"), "live", checkpoint=point)
    assert sorted((r.k, r.v, r.hit) for r in got.collect()) == [("a", "x", False), ("a", "x", True), ("a", "z", False), ("b", "q", False), ("c", "w", False)]
    assert stated(spark, point) == 1  # a and b are gone


def test_first_of_key_and_counts(spark, log):
    folder, batch = log
    got = streaming.run_to_end(streaming.first_of_key(streaming.read_events(spark, folder, batch.schema, 10), "user_id", "3650 days"), "firsts")
    assert got.count() == batch.select("user_id").distinct().count()
    hits = streaming.run_to_end(streaming.minute_counts(streaming.read_events(spark, folder, batch.schema, 10), ["event_type"], 3600), "hits", "complete")
    assert hits.agg(F.sum("hits")).first()[0] == batch.count()


def test_anchored_stream_equals_batch(spark, log):
    folder, batch = log
    s = streaming.read_events(spark, folder, batch.schema, 10)
    got = streaming.run_to_end(streaming.anchored(s, "user_id", 2, 86_400), "anchored")
    want = ratelimit.anchored_window(batch, "user_id", "ts", 2, 86_400).select("user_id", "event_id", "hit", "blocked")
    assert rows(got) == rows(want)


def test_status_change_stream_equals_batch(spark, log):
    folder, batch = log
    s = streaming.read_events(spark, folder, batch.schema, 10).select("user_id", "ts", F.col("event_type").alias("status"))
    got = streaming.run_to_end(streaming.status_changes(s, "user_id"), "changed")
    want = jobs.changes(batch.select("user_id", "ts", F.col("event_type").alias("status")), "user_id", "ts").select("user_id", "ts", "status")
    assert rows(got) == rows(want)


def test_changes_end_with_a_job(spark, tmp_path):
    seen = [("j", 0, "queued"), ("j", 1, "running"), ("j", 2, "running"), ("j", 3, "failed"), ("j", 4, "queued"), ("k", 0, "queued"), ("k", 61, "running")]
    df = spark.createDataFrame(seen, "job string, s long, status string").select("job", F.timestamp_seconds(F.col("s") + 10**6).alias("ts"), "status")
    df.coalesce(1).write.parquet(str(tmp_path / "h"))
    stream = streaming.status_changes(streaming.read_events(spark, str(tmp_path / "h"), df.schema), "job", terminal=streaming.TERMINAL, seconds=60)
    got = streaming.run_to_end(stream, "job_stream")
    assert sorted((r.job, r.status) for r in got.collect()) == [("j", "failed"), ("j", "queued"), ("j", "running"), ("k", "queued")]


def test_latency_window_equals_batch(spark, log):
    folder, batch = log
    made = batch.withColumn("service", F.lit("s"))
    stream = streaming.read_events(spark, folder, batch.schema, 10).withColumn("service", F.lit("s"))
    got = streaming.run_to_end(streaming.latency_window(stream, "service", most=300), "latencies", "update").collect()
    last = events.latency_summary(events.last_latencies(made, "duration_ms", most=300)).first()
    assert (last["count"], last["avg"], last["p50"], last["p95"]) in {(r["count"], r["avg"], r["p50"], r["p95"]) for r in got}


def test_creates_tell_conflicts(spark, tmp_path):
    hour = 3600
    made = [("a", 1, 0, "x"), ("a", 2, hour, "x"), ("a", 3, 2 * hour, "y"), ("a", 4, 30 * hour, "y"), ("b", 5, 0, "z")]
    df = spark.createDataFrame(made, "idem string, request_id long, s long, hash string").select("idem", "request_id", F.timestamp_seconds(F.col("s") + 10**6).alias("ts"), "hash")
    df.coalesce(1).write.parquet(str(tmp_path / "r"))
    got = streaming.run_to_end(streaming.creates(streaming.read_events(spark, str(tmp_path / "r"), df.schema), "idem", "hash"), "creates")
    assert {r.request_id: r.outcome for r in got.collect()} == {1: "created", 2: "replayed", 3: "conflict", 4: "created", 5: "created"}


def test_cancelled_jobs_end(spark):
    import threading
    import time

    failed = []

    def work():
        try:
            with streaming.cancellable(spark, "long"):
                spark.range(4).mapInPandas(lambda it: (time.sleep(30) or b for b in it), "id long").count()
        except Exception as e:
            failed.append(e)

    thread = threading.Thread(target=work)
    began = time.time()
    thread.start()
    while thread.is_alive() and time.time() - began < 20:
        streaming.cancel(spark, "long")
        thread.join(0.3)
    assert failed and time.time() - began < 25
