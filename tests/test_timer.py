"""Idle sessions by the clock, on a stream whose events end."""

import time

import pytest

from siltstone.streaming import timer


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, timer.PROVIDER)
    yield
    spark.conf.set(key, old)


def put(spark, path, rows):
    spark.createDataFrame(rows, "session_id string, ts string").selectExpr("session_id", "cast(ts as timestamp) ts").coalesce(1).write.mode("append").parquet(path)


def test_the_last_session_comes_out(spark, rocks, tmp_path):
    where = str(tmp_path / "in")
    put(spark, where, [("a", "2026-01-01 00:00:00"), ("a", "2026-01-01 00:05:00"), ("b", "2026-01-01 00:01:00")])
    events = spark.readStream.schema("session_id string, ts timestamp").parquet(where)
    got = []
    done = timer.Processed(spark, str(tmp_path / "done"))
    handle = done.once(lambda df, n: got.extend((r["session_id"], r["events"], n) for r in df.collect()))
    q = timer.run(timer.ready_sessions(events, idle_ms=4000), handle, str(tmp_path / "ck"), "1 second")
    try:
        end = time.time() + 90
        while {g[0] for g in got} != {"a", "b"} and time.time() < end:
            assert q.exception() is None
            time.sleep(0.5)
    finally:
        q.stop()
    assert {g[:2] for g in got} == {("a", 2), ("b", 1)}  # with no event after them
    # a batch that is run again hands on what it did, and adds nothing
    before = sorted(map(tuple, done.table().collect()))
    number = got[0][2]
    again = spark.createDataFrame([(r[0], r[1]) for r in before], "session_id string, start timestamp")
    count = len(got)
    done.once(lambda df, n: got.extend(df.collect()))(again.filter("session_id = 'a'"), number + 1)
    assert len(got) == count
    done.once(lambda df, n: None)(again, number)
    assert sorted(map(tuple, done.table().distinct().collect())) == before


def test_an_event_resets_the_timer(spark, rocks, tmp_path):
    where = str(tmp_path / "in")
    put(spark, where, [("a", "2026-01-01 00:00:00")])
    events = spark.readStream.schema("session_id string, ts timestamp").parquet(where)
    got = []
    q = timer.run(timer.ready_sessions(events, idle_ms=8000), lambda df, n: got.extend(tuple(r) for r in df.select("session_id", "events").collect()), str(tmp_path / "ck"), "500 milliseconds")
    try:
        deadline = time.time() + 40
        while not q.recentProgress or not any(p["numInputRows"] for p in q.recentProgress):
            assert time.time() < deadline and q.exception() is None
            time.sleep(0.2)
        put(spark, where, [("a", "2026-01-01 00:30:00")])
        deadline = time.time() + 60
        while not got and time.time() < deadline:
            assert q.exception() is None
            time.sleep(0.3)
    finally:
        q.stop()
    assert got == [("a", 2)]
