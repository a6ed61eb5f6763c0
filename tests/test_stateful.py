"""Streams stopped and started again against batch results and plain loops."""

from datetime import datetime, timedelta

import pytest
from curata.operators import limits
from curata.streaming import stateful
from pyspark.sql import functions as F


@pytest.fixture
def few(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_quota_resumes_and_equals_the_batch(few, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(k, k % 3, t0 + timedelta(hours=7 * (k // 2))) for k in range(90)] + [(100, None, t0), (101, 1, None)]
    df = few.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    source = str(tmp_path / "in")
    early = df.where(F.col("ts") < t0 + timedelta(days=6))
    stateful.staged(early, "ts", source, 2)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    go = lambda: stateful.run(stateful.quota(stateful.arrivals(few, source, df.schema), "user_id", "ts", "event_id", 4, 3), out, checkpoint)
    assert len([p for p in go().recentProgress if p["numInputRows"]]) == 2
    half = few.read.parquet(out).count()
    stateful.staged(df.join(early, "event_id", "left_anti"), "ts", source, 3, first=2)
    query = go()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]]
    assert max(state) <= 3
    got = sorted(map(tuple, few.read.parquet(out).select("event_id", "user_id", "period", "used").collect()))
    want = sorted(map(tuple, limits.admitted(df, "user_id", "ts", "event_id", 4, 3).select("event_id", "user_id", "period", "used").collect()))
    assert got == want and half < len(got)
    go()
    assert few.read.parquet(out).count() == len(want)


def test_seen_keys_are_dropped_and_forgotten(few, tmp_path):
    t0 = datetime(2024, 1, 1)
    day = lambda d: t0 + timedelta(days=d)
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    schema = "id long, ts timestamp, n long"
    batches = [[(1, day(0), 1), (1, day(0), 0), (None, day(0), 9), (2, day(1), 2)], [(1, day(3), 3), (3, day(3), 4)], [(4, day(30), 5)], [(5, day(31), 6)], [(1, day(32), 7)]]
    states = []
    for k, rows in enumerate(batches):
        few.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/arrival={k:03d}")
        stream = stateful.arrivals(few, source, few.createDataFrame([], schema).schema)
        query = stateful.run(stateful.first_sights(stream, "id", "ts", "n", 5), out, checkpoint)
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = sorted((r.id, r.n) for r in few.read.parquet(out).collect())
    assert got == [(1, 0), (1, 7), (2, 2), (3, 4), (4, 5), (5, 6)]
    assert states[-1] <= states[1] + 3


def test_a_key_costs_few_calls_of_the_state_store():
    calls, timers = [], []

    class Store:
        value = None

        def __getattr__(self, name):
            def call(*a):
                calls.append(name)
                if name in ("update", "clear"):
                    self.value = a[0] if a else None
                return self.value is not None if name == "exists" else self.value

            return call

        getValueState = lambda self, *_: self
        registerTimer = lambda self, at: timers.append(at)

    class Rang:
        getExpiryTimeInMs = staticmethod(lambda: timers[-1])

    seen = stateful.Seen("ts", ["id"], "n", 1)
    seen.init(Store())
    row = lambda ts: {"ts": ts, "n": 0, "id": 7}
    assert [r.id for r in seen.handleInputRows((7,), [row(0)], None)] == [7]
    assert not list(seen.handleInputRows((7,), [row(5000)], None))
    assert calls == ["get", "update", "get", "update"] and timers == [stateful.DAY // 1000 + 1]
    list(seen.handleExpiredTimer((7,), None, Rang()))
    assert seen.state.value and timers[1:] == [(stateful.DAY + 5000) // 1000 + 1]  # it was seen later: the timer is set anew
    list(seen.handleExpiredTimer((7,), None, Rang()))
    assert seen.state.value is None
