"""Streams against tables: rows in any order within the delay, in many batches, over restarts."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest

from gristmill.streaming import sessions

START = dt.datetime(2024, 1, 1)


def batches(rng, rows, size, swing):
    """Rows that come up to ``swing`` minutes late, in batches."""
    late = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.random() * swing))
    return [late[i : i + size] for i in range(0, len(late), size)]


def arrive(spark, folder, number, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{number:03}")


@pytest.mark.parametrize(("name", "ordered"), [("moved", "ordered_moves"), ("shown_once", "ordered_notes")])
def test_streams_in_event_time_order(spark, tmp_path, name, ordered):
    rng = random.Random(7)
    key, value = ("session", "head") if name == "moved" else ("repo", "key")
    schema = f"{key} long, ts timestamp, ord long, {value} string"
    rows = [(rng.randrange(4), START + dt.timedelta(seconds=20 * (i // 2)), i, rng.choice(["a", "b", None])) for i in range(240)]
    end = [(99, START + dt.timedelta(days=1), 999, "z")]  # moves the watermark past all others
    parts = [*batches(rng, rows, 60, 8), end]
    rng.shuffle(parts[0])
    whole, stream = getattr(sessions, name), getattr(sessions, ordered)
    for n, part in enumerate(parts):  # a run for each batch: a restart from the state that the one before has left
        arrive(spark, f"{tmp_path}/in", n, part, schema)
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        got = sessions.run_stream(stream(source, "10 minutes"), f"{tmp_path}/out")
    want = [tuple(r) for r in whole(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 40


class Held(list):
    """A list state."""

    def __init__(self, handle=None):
        self.timers = []

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        return None

    def registerTimer(self, at):
        self.timers.append(at)

    def appendList(self, rows):
        self.extend(rows)

    appendValue = list.append


def test_rows_that_wait_are_one_value_a_batch():
    held = Held()
    step = sessions.InOrder(["session", "ts", "ord", "head"], "session long, ts timestamp, ord long, head string", "head", False)
    step.init(held)
    n = 500
    batch = lambda k: pd.DataFrame({"session": 1, "ts": [START + dt.timedelta(microseconds=1500 + k + i) for i in range(n)], "ord": range(n), "head": [None, "a"] * (n // 2)})
    list(step.handleInputRows((1,), iter([batch(0), batch(n)]), None))
    assert len(held) == 2
    assert held.timers == [int(START.replace(tzinfo=dt.UTC).timestamp() * 1000) + 2]


@pytest.mark.parametrize("step", [1, 360])
def test_notes_are_packed_before_they_meet_state(spark, step):
    gap = step * 3600 * 1000 * 2  # 40 000 rows of three days, or three years, in no order
    rows = spark.range(40_000, numPartitions=2).selectExpr("CASE WHEN id % 4 > 0 THEN id % 4 END AS repo", f"CASE WHEN id > 9 THEN (id * 7919) % 40000 * {gap} - 1 END AS at", "id AS ord", "'k' AS key").where("at IS NOT NULL")
    packs = sessions.packed(rows, "repo").withColumn("high", sessions.F.unix_micros("ts")).collect()
    assert len(packs) <= 2 * 4 * 12  # two tasks, four repositories, slices of some 500 rows
    spans = {(p["start"], p["end"]) for p in packs}
    assert all(a == c or a[1] <= c[0] or c[1] <= a[0] for a in spans for c in spans) and len(spans) > 3
    held = []
    for p in packs:
        inside = sessions._unpacked([p["rows"]]).to_pylist()
        held += inside
        assert {r["repo"] for r in inside} == {int(p["name"]) if p["name"] else None}
        ms = [-(-r["at"] // 1000) for r in inside]
        assert (p["low"], p["high"]) == (min(ms), max(r["at"] for r in inside))
        assert all(p["start"] <= m < p["end"] for m in ms)
    assert sorted(r["ord"] for r in held) == list(range(10, 40_000))


@pytest.mark.parametrize(("zone", "width"), [("America/New_York", 60_000), ("Asia/Tokyo", 24 * 3_600_000)])
def test_notes_over_slices_in_any_zone(spark, tmp_path, monkeypatch, zone, width):
    monkeypatch.setattr(sessions, "SLICE", width, raising=False)
    rng = random.Random(9)
    schema = "repo long, ts timestamp, ord long, key string"
    rows = [(rng.choice([0, 1, 2**60 + 1, None]), START + dt.timedelta(seconds=7 * (i // 2), microseconds=rng.randrange(1500)), i, rng.choice(["a", "b", None])) for i in range(600)]
    parts = batches(rng, rows, 150, 8)
    for n, part in enumerate(parts[2:], 2):  # late by far, in a pack with others if slices are wide
        part.extend((r, START + dt.timedelta(minutes=3 * n - 9, microseconds=1), 5000 + n, "z") for r in (0, 1, 2**60 + 1, None))
    parts.append([(99, START + dt.timedelta(days=1), 999, "z")])
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for n, part in enumerate(parts):
            monkeypatch.setattr(sessions, "ROWS", (2, 40, 5)[n % 3], raising=False)  # slices of several widths
            arrive(spark, f"{tmp_path}/in", n, part, schema)
            source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
            got = sessions.run_stream(sessions.ordered_notes(source, "10 minutes"), f"{tmp_path}/out")
            if n == 1:
                assert got.count() > 0  # rows go out before all have come
        want = sessions.shown_once(spark.createDataFrame(rows, schema)).collect()
        order = lambda r: (r["ord"], str(r))
        assert sorted(got.collect(), key=order) == sorted(want, key=order) and len(want) > 200
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def test_moves_in_a_zone_that_is_not_utc(spark, tmp_path):
    rng = random.Random(10)
    schema = "session long, ts timestamp, ord long, head string"
    rows = [(rng.randrange(3), START + dt.timedelta(seconds=20 * i, microseconds=rng.randrange(1500)), i, rng.choice(["a", "b", None])) for i in range(120)]
    parts = [*batches(rng, rows, 60, 8), [(99, START + dt.timedelta(hours=2), 999, "z"), (0, None, 998, "y")]]
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for n, part in enumerate(parts):
            arrive(spark, f"{tmp_path}/in", n, part, schema)
            source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
            got = sessions.run_stream(sessions.ordered_moves(source, "10 minutes"), f"{tmp_path}/out")
        want = sessions.moved(spark.createDataFrame(rows, schema)).collect()
        assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want) and len(want) > 20
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def test_recent_sessions_as_a_stream(spark, tmp_path):
    rng = random.Random(8)
    schema = "session long, ts timestamp, ord long, head string"
    rows = [(rng.randrange(150), START + dt.timedelta(seconds=i // 3), i, rng.choice("abc")) for i in range(900)]
    want = [tuple(r) for r in sessions.recent_sessions(spark.createDataFrame(rows, schema), 20).collect()]
    rng.shuffle(rows)
    for n in range(3):
        arrive(spark, f"{tmp_path}/in", n, rows[300 * n : 300 * n + 300], schema)
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        got = sessions.run_stream(sessions.recent_stream(source, 20, 4), f"{tmp_path}/out")
    assert sorted(tuple(r) for r in sessions.recent_sessions(got, 20).collect()) == sorted(want)
    assert got.count() < len(rows)
