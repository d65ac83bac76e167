"""Stateful streams: any file order, any cut into micro-batches, restarts, late rows, state that is freed."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from petrograph.operators.sequences import debounce, neighbour
from petrograph.operators.throttle import throttle
from petrograph.sources.views import tick_view
from petrograph.streaming import streams as S

T0 = dt.datetime(2024, 3, 1)
SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, session_id bigint"


def events(n=240, seed=1):
    """Rows of three users, bursts and gaps included, some at equal times and exactly 300 s or an hour apart."""
    rng = random.Random(seed)
    rows, t = [], T0
    for i in range(n):
        t += dt.timedelta(seconds=rng.choice([0, 1, 60, 299, 300, 301, 3600, 20_000]))
        rows.append((i, t, rng.randrange(3), rng.choice(["signup", "signup", "view", "purchase"]), round(rng.uniform(1, 99), 2), i % 7))
    return rows


class Table:
    """An events table as a folder of files that the stream reads in the order they were added."""

    def __init__(self, spark, path):
        self.spark, self.path, self.files = spark, str(path), 0
        os.makedirs(f"{self.path}/events.parquet", exist_ok=True)

    def add(self, rows):
        import pandas as pd
        import pyarrow as pa
        import pyarrow.parquet as pq

        schema = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()),
                            ("value", pa.float64()), ("session_id", pa.int64())])
        t = pa.Table.from_pandas(pd.DataFrame(rows, columns=schema.names), schema=schema, preserve_index=False)
        place = f"{self.path}/events.parquet/part-{self.files:05d}.parquet"
        pq.write_table(t, place)
        os.utime(place, (1_700_000_000 + self.files, 1_700_000_000 + self.files))
        self.files += 1

    def stream(self, max_files=1):
        return S.events_stream(self.spark, self.path, max_files)


def pieces(rows, n):
    return [rows[i * len(rows) // n:(i + 1) * len(rows) // n] for i in range(n)]


def orders(rows):
    shuffled = rows[:]
    random.Random(5).shuffle(shuffled)
    return {"one file": [rows], "in order": pieces(rows, 4), "reversed": pieces(rows, 4)[::-1], "shuffled": pieces(shuffled, 3)}


def table(df):
    return sorted(map(tuple, df.collect()), key=str)


def batch_changes(spark, rows):
    ticks = tick_view(spark.createDataFrame(rows, SCHEMA))
    both = neighbour(ticks, ["price_type"], ["ts", "id"], ["price"])
    return {r.id: (r.ts, r.price_type, r.price, r.prev_price) for r in both.collect()}


@pytest.mark.parametrize("order", ["one file", "in order", "reversed", "shuffled"])
def test_ticks_chain_in_event_order_however_files_come(spark, tmp_path, order):
    rows = events()
    t = Table(spark, tmp_path)
    for part in orders(rows)[order]:
        t.add(part)
    j = S.job(spark, "t", str(tmp_path / "job"))
    got = j.finish(S.price_change_stream(t.stream(), j.heartbeats(), slot_ms=S.HOUR_MS * 5)).collect()
    assert {r.id: (r.ts, r.price_type, r.price, r.prev_price) for r in got} == batch_changes(spark, rows)
    assert len(got) == len({r.id for r in got}) and j.dropped_rows == 0


def test_ticks_after_a_restart_and_late_ticks(spark, tmp_path):
    rows = events()
    t, root = Table(spark, tmp_path), str(tmp_path / "job")
    first, second, third = pieces(rows, 3)
    late = (9000, T0 - dt.timedelta(days=3), 0, "signup", 5.0, 0)
    t.add(first)
    j = S.job(spark, "t", root)
    some = j.run(S.price_change_stream(t.stream(), j.heartbeats(), delay="2 hours", slot_ms=S.HOUR_MS)).count()
    assert 0 < some < len(rows)
    t.add(second)
    t.add([late])
    again = S.job(spark, "t", root)         # a new process would make the same object
    again.run(S.price_change_stream(t.stream(), again.heartbeats(), delay="2 hours", slot_ms=S.HOUR_MS))
    is_tick = tick_view(spark.createDataFrame([late], SCHEMA)).count()
    assert again.dropped_rows == is_tick
    t.add(third)
    last = S.job(spark, "t", root)
    got = last.finish(S.price_change_stream(t.stream(), last.heartbeats(), delay="2 hours", slot_ms=S.HOUR_MS)).collect()
    assert {r.id: (r.ts, r.price_type, r.price, r.prev_price) for r in got} == batch_changes(spark, rows)


def test_windows_close_once_and_free_their_state(spark, tmp_path):
    rows = events(400)
    t, root = Table(spark, tmp_path), str(tmp_path / "job")
    for part in pieces(rows, 5):
        t.add(part)
    t.add([(9000, T0 - dt.timedelta(days=9), 0, "signup", 5.0, 0)])
    j = S.job(spark, "w", root)
    open_yet = j.run(S.event_windows(t.stream(), j.heartbeats(), delay="1 hour"))
    assert j.dropped_rows == 1
    days = {r[1].date() for r in rows}
    assert 0 < len({r.window_start for r in open_yet.collect()}) < len(days)
    assert max(j.state_rows) > j.state_rows[-1]
    got = j.finish(S.event_windows(t.stream(), j.heartbeats(), delay="1 hour"))
    want = (S.event_view(spark.createDataFrame(rows, SCHEMA)).groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz"), "severity").count())
    assert table(got) == table(want) and j.state_rows[-1] <= 1


@pytest.mark.parametrize("order", ["in order", "reversed"])
def test_debounce_and_throttle_equal_the_batch(spark, tmp_path, order):
    rows = events(300, seed=2)
    parts = orders(rows)[order]
    t = Table(spark, tmp_path)
    for part in parts[:2]:
        t.add(part)
    jobs = {}
    for name, build in (("debounce", S.debounced_stream), ("throttle", S.throttled_stream)):
        jobs[name] = S.job(spark, name, str(tmp_path / name))
        jobs[name].run(build(t.stream(), jobs[name].heartbeats()))
    for part in parts[2:]:
        t.add(part)
    df = spark.createDataFrame(rows, SCHEMA).select(F.col("event_id").alias("id"), "user_id", "ts", "value")
    for name, build, want in (("debounce", S.debounced_stream, debounce(df, "user_id", 300)),
                              ("throttle", S.throttled_stream, throttle(df, "user_id", 3600))):
        j = S.job(spark, name, str(tmp_path / name))
        got = j.finish(build(t.stream(), j.heartbeats()))
        assert table(got.select("id", "user_id", "ts", "value")) == table(want.select("id", "user_id", "ts", "value")), name


def test_throttle_forgets_idle_users(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(hours=i), i, "signup", 1.0, 0) for i in range(30)]
    t = Table(spark, tmp_path)
    for part in pieces(rows, 6):
        t.add(part)
    j = S.job(spark, "t", str(tmp_path / "job"))
    j.run(S.throttled_stream(t.stream(), j.heartbeats(), delay="1 hour", slot_ms=S.HOUR_MS))
    assert j.state_rows[-1] < 30
