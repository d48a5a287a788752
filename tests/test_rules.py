"""Rules that change between batches: looked at now and then, the same again in a replay."""

import json

import pytest
from pyspark.sql import functions as F

from pagemill.functions import pages
from pagemill.streaming import events as streaming
from pagemill.streaming import rules


def saved(path, *domains):
    path.write_text(json.dumps([{"domains": [d], "removeSelectors": [".x"]} for d in domains]))


@pytest.fixture
def at(spark, tmp_path):
    now = [0.0]
    make = lambda: rules.Refreshed(spark, str(tmp_path / "rules.json"), str(tmp_path / "ledger"), clock=lambda: now[0])
    return tmp_path / "rules.json", now, make


def domains(found):
    return sorted(d for r in found for d in r["domains"])


def test_looked_at_every_minute_and_replayed(at):
    path, now, make = at
    one = make()
    assert one.of_batch(0) == pages.PAYWALL_RULES  # no file yet
    saved(path, "a.org")
    now[0] = 59
    assert one.of_batch(1) == pages.PAYWALL_RULES
    now[0] = 60
    assert domains(one.of_batch(2)) == ["a.org"]
    saved(path, "b.org")
    now[0] = 200
    assert domains(one.of_batch(2)) == ["a.org"]  # a replay
    path.write_text("{no json")
    assert domains(one.of_batch(3)) == ["a.org"]
    again = make()
    assert domains(again.of_batch(3)) == ["a.org"] and domains(again.of_batch(4)) == ["a.org"]  # bad JSON keeps what the stream had
    saved(path, "c.org")
    now[0] = 300
    assert domains(again.of_batch(5)) == ["c.org"]


def test_a_stream_takes_each_batch_with_its_rules(spark, at, tmp_path):
    path, now, make = at
    for i, d in enumerate(["a.org", "b.org", "a.org"]):
        spark.createDataFrame([(i, d)], "n int, host string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    saved(path, "a.org")
    seen = []

    def write(batch, table, number):
        found = pages.with_paywall_rule(batch, table).select("n", F.col("domain").isNotNull().alias("ruled")).collect()
        seen.extend((number, r.n, r.ruled) for r in found)
        if number == 0:
            saved(path, "b.org")
            now[0] += 60

    stream = streaming.read_events(spark, str(tmp_path / "in"), "n int, host string", 1)
    stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(make().sink(write)).start().awaitTermination()
    assert seen == [(0, 0, True), (1, 1, True), (2, 2, False)]
