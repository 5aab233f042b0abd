"""Keyed tables under repeated and failed batches, claims of runs that start at once, and streams over several batches."""

import threading
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postmill.operators.tables import Claims, KeyedTable
from postmill.streaming import state as streams

SCHEMA = "k string, v bigint, t bigint"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


@pytest.mark.parametrize(
    "rule, want",
    [("first", [("a", 1, 5), ("b", 3, 2), ("c", 5, 9), (None, 9, 1)]), ("last", [("a", 4, 7), ("b", 3, 2), ("c", 5, 9), (None, 9, 1)]), ("sum", [("a", 7, 7), ("b", 3, 2), ("c", 5, 9), (None, 9, 1)])],
)
@pytest.mark.parametrize("compacted", [(), (0,), (0, 1, 2)])
def test_rules_batches_and_compaction(spark, tmp_path, rule, want, compacted):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], rule, None if rule == "sum" else "t", sums=("v",), tops=("t",), buckets=3)
    assert rows(table.read()) == []
    batches = [frame(spark, ("a", 1, 5), ("a", 2, 6)), frame(spark, ("a", 4, 7), ("b", 3, 2), (None, 9, 1)), frame(spark, ("c", 5, 9))]
    for n, batch in enumerate(batches):
        assert table.write(batch, n) and table.write(batch, n)  # the second time changes nothing
        if n in compacted:
            assert table.compact() == n and not table.write(frame(spark, ("z", 1, 1)), n)
    assert rows(table.read()) == sorted(want, key=repr)


def test_a_batch_that_failed_halfway_is_not_read_and_comes_again(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], "last", "t")
    table.write(frame(spark, ("a", 1, 1)), 0)
    boom = F.udf(lambda v: 1 // (v - 2) and v, "bigint")
    with pytest.raises(Exception):
        table.write(frame(spark, ("a", 5, 5), ("b", 2, 5)).withColumn("v", boom("v")), 1)
    assert rows(table.read()) == [("a", 1, 1)]
    table.write(frame(spark, ("a", 5, 5), ("b", 2, 5)), 1)
    assert rows(table.read()) == [("a", 5, 5), ("b", 2, 5)] and rows(table.read(before=1)) == [("a", 1, 1)]
    assert table.compact(keep=F.col("k") != "b") == 1 and rows(table.read()) == [("a", 5, 5)]


def test_claims_at_once(spark, tmp_path):
    ticks = [Claims(spark, str(tmp_path / "claims"), shares=24) for _ in range(4)]
    gate, got = threading.Barrier(4), {}

    def run(n):
        gate.wait()
        got[n] = ticks[n].take()

    threads = [threading.Thread(target=run, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(x for own in got.values() for x in own) == list(range(24))
    users = spark.range(500).select(F.col("id").cast("string").alias("user_id"))
    assert sum(t.mine(users).count() for t in ticks) == 500
    late = Claims(spark, str(tmp_path / "claims"), shares=24)
    assert late.take() == [] and late.mine(users).count() == 0
    first = got[0]
    ticks[0].release()
    assert late.take(most=len(first)) == first
    # the time of the other claims is over: others may have their shares, each again once
    after, rival = (Claims(spark, str(tmp_path / "claims"), shares=24, ttl_seconds=60) for _ in range(2))
    assert after.take(now=time.time() + 100) == list(range(24)) and rival.take(now=time.time() + 50) == []
    after.purge(older_than=time.time() + 1)
    assert rival.take(now=time.time() + 50) == []


def test_peaks_with_late_calls_restarts_and_an_end(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    at = lambda *seconds: [("u", t0 + timedelta(seconds=s)) for s in seconds]
    batches = [at(0, 10, 20) + [("v", t0)] * 3, at(100, 110), at(30, 35, 40), at(5000), at(31, 5010), at(9000) + [("v", t0 + timedelta(seconds=9000))]]
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, "k string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
        streams.written(streams.peaks(source, "k", late="10 minutes"), str(tmp_path / "out"), "update")
        updates = spark.read.parquet(str(tmp_path / "out/rows"))
        peak = {r["k"]: r["p"] for r in updates.groupBy("k").agg(F.max("peak").alias("p")).collect()}
        # the third batch is late by a minute and more: its calls meet those of their own time; the one at 31 in the fifth is too late
        assert peak["u"] == (3 if n < 2 else 6), n
    by_batch = {(r["k"], r["batch"]): r["peak"] for r in updates.collect()}
    newest = max(b for k, b in by_batch if k == "u")
    # v has been silent until the watermark was past it, so its state has gone and it starts anew; u has not
    assert by_batch[("v", min(b for k, b in by_batch if k == "v"))] == 3
    assert by_batch[("u", newest)] == 6 and by_batch[("v", newest)] == 1


def test_history_batch_again(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "h"), SCHEMA, ["k"], "last", "t")
    place = str(tmp_path / "told")
    for n, batch in enumerate([frame(spark, ("a", 1, 1), ("b", 1, 1)), frame(spark, ("a", 2, 2), ("c", 1, 2)), frame(spark, ("c", 3, 3))]):
        for _ in range(2):
            streams.rolling_history(batch, n, table, place, every=2, keep=F.col("k") != "b")
    told = spark.read.parquet(place).select("k", "t", "known")
    assert rows(told) == [("a", 1, False), ("a", 2, True), ("b", 1, False), ("c", 2, False), ("c", 3, True)]
    assert rows(table.read()) == [("a", 2, 2), ("c", 3, 3)]
