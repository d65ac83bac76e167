"""Versioned snapshots: only changed parts are written, and a failed write is never read."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from petrograph.plans.snapshots import SnapshotStore

T0 = dt.datetime(2024, 1, 1)


def frames(spark, change=None, days=4):
    ev = [(i, T0 + dt.timedelta(days=i % days, hours=i % 5), float(i)) for i in range(40)] + [(99, None, 1.0)]
    if change is not None:
        ev = [(i, t, v + 1 if i == change else v) for i, t, v in ev]
    return {"event": spark.createDataFrame(ev, "id long, ts timestamp_ntz, v double"),
            "country": spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")}


def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "s"), {"event": ("day", F.to_date("ts"))})


def rows(df):
    return sorted(map(str, df.collect()))


def files(s, name):
    return {str(r.f).split("/data/")[1] for r in s.read(name).select(F.input_file_name().alias("f")).distinct().collect()}


def test_unchanged_days_keep_their_files(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.current() is None and s.read("event") is None
    assert s.write(frames(spark)) == 1
    first = files(s, "event")
    assert rows(s.read("event").drop("day")) == rows(frames(spark)["event"])
    assert s.write(frames(spark)) == 2 and files(s, "event") == first       # nothing changed: nothing written
    s.write(frames(spark, change=6))                                        # one day of five
    now = files(s, "event")
    assert len(first - now) == len(now - first) >= 1
    assert {f.split("day=")[1].split("/")[0] for f in now - first} == {"2024-01-03"}
    assert rows(s.read("event").drop("day")) == rows(frames(spark, change=6)["event"])
    assert rows(s.read("event", 1).drop("day")) == rows(frames(spark)["event"])
    s.write(frames(spark, days=2))                                          # days that are gone leave the snapshot
    assert rows(s.read("event").drop("day")) == rows(frames(spark, days=2)["event"])
    assert {r.entity: r.n for r in s.counts().collect()} == {"event": 41, "country": 2}


def test_a_write_that_dies_leaves_the_former_snapshot(spark, tmp_path):
    s = store(spark, tmp_path)
    s.write(frames(spark))

    def dies(name):
        raise KeyboardInterrupt(name)

    with pytest.raises(KeyboardInterrupt):
        s.write(frames(spark, change=3), after_entity=dies)
    again = store(spark, tmp_path)
    assert again.current() == 1 and rows(again.read("event").drop("day")) == rows(frames(spark)["event"])
    assert again.write(frames(spark, change=3)) == 3            # the number of the dead version isn't used again
    assert rows(again.read("event").drop("day")) == rows(frames(spark, change=3)["event"])


def test_empty_entity(spark, tmp_path):
    s = store(spark, tmp_path)
    s.write({"event": frames(spark)["event"].limit(0), "country": frames(spark)["country"]})
    assert s.read("event") is None and s.read("country").count() == 2
