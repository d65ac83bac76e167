"""Segmented sequence operators against brute force on small random fixtures.

The fixtures spread rows over many days with empty days between them and duplicate
timestamps, and force few rows a segment, so carries cross many segments.
"""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from petrograph.operators.segments import SEGMENT, with_segment
from petrograph.operators.sequences import debounce, neighbour, ordinal_index
from petrograph.operators.throttle import throttle
from petrograph.operators.timeseries import asof, trailing_sums

T0 = dt.datetime(2024, 1, 1)


def _series(n=400, keys=3, span_s=6 * 86400, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # clustered times with gaps: pick a day among a few, then a second
        day = rnd.choice([0, 1, 3, 4])
        sec = rnd.randrange(0, 86400) if rnd.random() < 0.9 else 3600  # many equal times
        rows.append((i, rnd.randrange(keys), T0 + dt.timedelta(days=day, seconds=sec), round(rnd.uniform(1, 99), 2)))
    return rows


@pytest.fixture(scope="module")
def series(spark):
    rows = _series()
    return rows, spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz, v double")


def _sorted_by_key(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        by.setdefault(r[1], []).append(r)
    return by


@pytest.mark.parametrize("partitions", [None, 1, 20, 130])
def test_neighbour_prev_and_next(spark, series, partitions):
    rows, df = series
    want_prev, want_next = {}, {}
    for seq in _sorted_by_key(rows).values():
        for i, r in enumerate(seq):
            want_prev[r[0]] = seq[i - 1][3] if i else None
            want_next[r[0]] = seq[i + 1][2] if i + 1 < len(seq) else None
    got = neighbour(df, ["k"], ["ts", "id"], ["v"], partitions=partitions).collect()
    assert {r["id"]: r["prev_v"] for r in got} == want_prev
    got = neighbour(df, ["k"], ["ts", "id"], ["ts"], direction="next", partitions=partitions).collect()
    assert {r["id"]: r["next_ts"] for r in got} == want_next


def test_hot_key_is_spread_over_segments(spark):
    rows = [(i, int(i % 3 == 0), T0 + dt.timedelta(seconds=i)) for i in range(3000)]
    df = with_segment(spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz"), ["k"], ["ts", "id"], 20)
    sizes = df.groupBy("k", SEGMENT).count()
    assert sizes.where("k = 0").count() >= 10 and sizes.agg(F.max("count")).first()[0] < 400


def test_tie_groups_are_cut_by_tie_break(spark):
    # 2,000 rows at one instant: only the tie-break can split them
    df = spark.createDataFrame([(i, 0, T0) for i in range(2000)], "id long, k long, ts timestamp_ntz")
    sizes = [r["count"] for r in with_segment(df, ["k"], ["ts", "id"], 10).groupBy(SEGMENT).count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 500
    prev = neighbour(df.withColumn("v", F.col("id") * 2), ["k"], ["ts", "id"], ["v"], partitions=10)
    got = {r["id"]: r["prev_v"] for r in prev.collect()}
    assert got == {i: (2 * (i - 1) if i else None) for i in range(2000)}


def test_one_row_a_key(spark):
    df = spark.createDataFrame([(i, i, T0, 1.0) for i in range(300)], "id long, k long, ts timestamp_ntz, v double")
    assert neighbour(df, ["k"], ["ts", "id"], ["v"], partitions=9).where("prev_v is not null").count() == 0


def test_both_branches_read_one_range_exchange(spark, series):
    """However unlike the columns that the window and the summaries use: one range exchange, reused."""
    from petrograph.plans.inspect import plan_text

    wide = series[1].select("*", *[F.lit(i).alias(f"c{i}") for i in range(5)])
    df = neighbour(wide, ["k"], ["ts", "id"], ["v"], partitions=7)
    df.collect()
    plan = plan_text(df).split("== Initial Plan ==")[0]
    assert len(re.findall(r"[+:]- Exchange rangepartitioning", plan)) == 1 and "ReusedExchange" in plan


def test_segments_that_differ_fail(spark, series):
    from petrograph.operators.segments import carried, in_segment, joined, summarised

    rows = with_segment(series[1], ["k"], ["ts", "id"], 5)
    other = with_segment(series[1].where("id > 20"), ["k"], ["ts", "id"], 5)
    met = rows.withColumn("_met", F.count(F.lit(1)).over(in_segment()))
    with pytest.raises(Exception, match="segments of one order differ"):
        joined(met, carried(summarised(other, F.max("id").alias("e")), "e", True, "s")).collect()


def test_no_job_before_the_action(spark, series):
    group = "before-the-action"
    spark.sparkContext.setJobGroup(group, "")
    try:
        neighbour(series[1], ["k"], ["ts", "id"], ["v"])
        asof(series[1], series[1], left_ts=F.col("ts"), right_ts="ts", right_order=["ts", "id"], values=["v"], keys=["k"])
        throttle(series[1], "k", 3600)
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)


@pytest.mark.parametrize("partitions", [None, 40])
def test_debounce(spark, series, partitions):
    rows, df = series
    want = set()
    for seq in _sorted_by_key(rows).values():
        for i, r in enumerate(seq):
            if i + 1 == len(seq) or (seq[i + 1][2] - r[2]).total_seconds() >= 300:
                want.add(r[0])
    assert {r["id"] for r in debounce(df, "k", 300, partitions=partitions).collect()} == want


def _greedy(rows, limit):
    want = set()
    for seq in _sorted_by_key(rows).values():
        last = None
        for r in seq:
            if last is None or (r[2] - last).total_seconds() >= limit:
                want.add(r[0])
                last = r[2]
    return want


@pytest.mark.parametrize("partitions", [None, 1, 60])
@pytest.mark.parametrize("limit", [3600, 60, 6 * 86400])
def test_throttle_matches_greedy(spark, series, limit, partitions):
    rows, df = series
    assert {r["id"] for r in throttle(df, "k", limit, partitions=partitions).collect()} == _greedy(rows, limit)


@pytest.mark.parametrize("limit,step,partitions", [(3600, 7, 8), (3600, 61, 40), (50, 7, 8), (100_000, 7, 16), (3600, 0, 5)])
def test_throttle_on_a_dense_hot_key(spark, limit, step, partitions):
    """One key without a gap: whole segments depend on what passed before them."""
    rnd = random.Random(limit + step)
    rows = [(i, 0, T0 + dt.timedelta(seconds=i * step + rnd.randrange(step + 1) // 2), 0.0) for i in range(6000)]
    rows += [(10_000 + i, 1, T0 + dt.timedelta(seconds=i), 0.0) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz, v double")
    assert {r["id"] for r in throttle(df, "k", limit, partitions=partitions).collect()} == _greedy(rows, limit)


def test_throttle_edges(spark):
    rows = [(1, 5, T0), (2, 5, None), (3, None, T0), (4, None, T0 + dt.timedelta(seconds=1)), (5, 5, T0)]
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz")
    assert sorted(r.id for r in throttle(df, "k", 10).collect()) == [1, 3]
    assert sorted(r.id for r in throttle(df, "k", 0).collect()) == [1, 3, 4, 5]
    assert throttle(df.limit(0), "k", 10).count() == 0


@pytest.mark.parametrize("direction,partitions", [("backward", None), ("forward", None), ("backward", 100),
                                                 ("forward", 100)])
def test_asof(spark, series, direction, partitions):
    rows, df = series
    rnd = random.Random(3)
    probes = [(1000 + j, rnd.randrange(3), T0 + dt.timedelta(seconds=rnd.randrange(-3600, 6 * 86400)))
              for j in range(150)]
    probes.append((2000, 0, rows[0][2]))   # exact time match
    pdf = spark.createDataFrame(probes, "pid long, k long, pts timestamp_ntz")
    got = asof(pdf, df, left_ts=F.col("pts"), right_ts="ts", right_order=["ts", "id"], values=["id"],
               keys=["k"], direction=direction, partitions=partitions).collect()
    by = _sorted_by_key(rows)
    want = {}
    for pid, k, t in probes:
        seq = by.get(k, [])
        if direction == "backward":
            c = [r for r in seq if r[2] <= t]
            want[pid] = c[-1][0] if c else None
        else:
            c = [r for r in seq if r[2] >= t]
            want[pid] = c[0][0] if c else None
    assert {r["pid"]: r["asof_id"] for r in got} == want


@pytest.mark.parametrize("partitions", [None, 70])
def test_trailing_sums(spark, series, partitions):
    rows, df = series
    ev = df.withColumn("x", F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("v")))
    pts = [(j, T0 + dt.timedelta(seconds=s)) for j, s in enumerate(range(0, 6 * 86400, 7919))]
    pdf = spark.createDataFrame(pts, "pid long, pts timestamp_ntz")
    got = {r["pid"]: (r["n_events"], r["x_sum"]) for r in trailing_sums(
        pdf, ev, point_id="pid", point_ts="pts", event_ts="ts", horizon_seconds=86400, values=["x"],
        partitions=partitions).collect()}
    for pid, t in pts:
        inside = [r for r in rows if t - dt.timedelta(days=1) < r[2] <= t]
        xs = [r[3] for r in inside if r[0] % 5 != 0]
        n, s = got[pid]
        assert n == len(inside)
        assert (s is None) if not xs else abs(s - sum(xs)) < 1e-6


def test_ordinal_index(spark, series):
    rows, df = series
    got = ordinal_index(df, [F.col("ts"), F.col("id")], partitions=5).collect()
    want = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    assert {r["id"]: r["ordinal"] for r in got} == want


def test_asof_and_trailing_sums_cut_same_instant_ties(spark):
    # 300 right rows and 100 probes all at one instant, plus probes after it
    right = spark.createDataFrame([(i, 0, T0) for i in range(300)], "id long, k long, ts timestamp_ntz")
    probes = [(1000 + j, 0, T0) for j in range(100)] + [(2000, 0, T0 + dt.timedelta(minutes=5))]
    pdf = spark.createDataFrame(probes, "pid long, k long, pts timestamp_ntz")
    got = {r["pid"]: r["asof_id"] for r in asof(
        pdf, right, left_ts=F.col("pts"), right_ts="ts", right_order=["ts", "id"], values=["id"],
        keys=["k"], partitions=12).collect()}
    assert set(got.values()) == {299}            # latest at or before: the last tie by id
    fwd = {r["pid"]: r["asof_id"] for r in asof(
        pdf, right, left_ts=F.col("pts"), right_ts="ts", right_order=["ts", "id"], values=["id"],
        keys=["k"], direction="forward", partitions=12).collect()}
    assert fwd[2000] is None and all(fwd[1000 + j] == 0 for j in range(100))
    ev = right.withColumn("x", F.lit(1.0))
    pts = spark.createDataFrame([(1, T0), (2, T0 + dt.timedelta(hours=1))], "pid long, pts timestamp_ntz")
    sums = {r["pid"]: r["n_events"] for r in trailing_sums(
        pts, ev, point_id="pid", point_ts="pts", event_ts="ts", horizon_seconds=86400, values=["x"],
        partitions=12).collect()}
    assert sums == {1: 300, 2: 300}
