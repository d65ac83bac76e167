"""Distributed time-series joins Spark has no operator for: as-of lookup and
trailing-window sums.

Both avoid a raw range join (no pairs are emitted) and avoid a window over a
whole key: they are segmented scans (see ``segments``).  Each (key, segment) is
one window partition, and what a segment needs from those before (or after)
it is read off a table of one row per key and segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petrograph.operators.segments import KEY, SEGMENT, carried, in_segment, joined, summarised, with_segment


def epoch_us(ts) -> Column:
    """Microseconds since the epoch of a zone-less timestamp (zone-independent)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, ts.cast("timestamp_ntz"))


def asof(left: DataFrame, right: DataFrame, *, left_ts: Column, right_ts: str, right_order: list[str],
         values: list[str], keys: list[str] | None = None, direction: str = "backward",
         prefix: str = "asof_", partitions: int | None = None) -> DataFrame:
    """Attach to every ``left`` row the ``values`` of one ``right`` row of the same ``keys``:

    * backward: the latest right row with ``right_ts <= left_ts`` (ties: last in ``right_order``);
    * forward:  the earliest right row with ``right_ts >= left_ts`` (ties: first in ``right_order``).

    ``left_ts`` is a Column over ``left`` (e.g. ``ts + horizon``).  The output
    is ``left``'s columns plus ``<prefix><value>``; unmatched rows get NULLs.
    """
    keys = keys or []
    if direction not in ("backward", "forward"):
        raise ValueError(direction)
    back = direction == "backward"
    lcols = left.columns
    # Right rows sort before left rows at equal time when looking backward
    # (included), after them when looking forward (also included).
    r_side, l_side = (0, 1) if back else (1, 0)

    lt = left.select(*keys, epoch_us(left_ts).alias("_t"), F.lit(l_side).alias("_side"),
                     F.lit(None).cast(right.select(F.struct(*right_order)).schema[0].dataType).alias("_ord"),
                     F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_val"),
                     F.struct(*[F.col(c) for c in lcols]).alias("_row"))
    rt = right.select(*keys, epoch_us(right_ts).alias("_t"), F.lit(r_side).alias("_side"),
                      F.struct(*right_order).alias("_ord"), F.struct(*values).alias("_val"),
                      F.lit(None).cast(lt.schema["_row"].dataType).alias("_row"))
    order = ["_t", "_side", "_ord"]
    both = with_segment(lt.unionByName(rt), keys, order, partitions)
    if back:
        frame = in_segment(order).rowsBetween(Window.unboundedPreceding, 0)
        near, pick = F.last("_val", ignorenulls=True).over(frame), F.max_by
    else:
        frame = in_segment(order).rowsBetween(0, Window.unboundedFollowing)
        near, pick = F.first("_val", ignorenulls=True).over(frame), F.min_by
    edge = pick("_val", F.when(F.col("_side") == r_side, F.struct("_t", "_ord")))
    edges = summarised(both, edge.alias("_edge"))
    windowed = both.withColumn("_near", near).withColumn("_met", F.count(F.lit(1)).over(in_segment()))
    found = (joined(windowed.filter(F.col("_side") == l_side), carried(edges, "_edge", back, "_seed"))
             .select("_row", F.coalesce("_near", "_seed").alias("_m")))
    return found.select(*[F.col(f"_row.{c}").alias(c) for c in lcols],
                        *[F.col(f"_m.{v}").alias(prefix + v) for v in values])


def trailing_sums(points: DataFrame, events: DataFrame, *, point_id: str, point_ts: str, event_ts: str,
                  horizon_seconds: int, values: list[str], scale: int = 12,
                  partitions: int | None = None) -> DataFrame:
    """For each point: ``n_events`` and ``<v>_sum`` over events with ts in (t - H, t].

    Uses prefix sums P(x) = (sum over segments before x's) + (running
    sum inside x's segment up to x), and answers each point with two probes:
    P(t) - P(t - H).  Rows at one instant are spread by a hash of all event
    columns (events) and by the point's id (probes).  Sums are carried as DECIMAL(38, scale) so that the
    difference of two large prefixes is exact.  A value's sum is NULL when
    no event in the window has a non-NULL value (SQL ``sum`` semantics).
    """
    dec = f"decimal(38,{scale})"
    ev = events.select(epoch_us(event_ts).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast("string").alias("_end"),
                       F.xxhash64(*events.columns).alias("_tie"), F.lit(None).cast(points.schema[point_id].dataType).alias("_pid"),
                       F.lit(1).cast("long").alias("_n"),
                       *[F.coalesce(F.col(v).cast(dec), F.lit(0).cast(dec)).alias(f"_s_{v}") for v in values],
                       *[F.col(v).isNotNull().cast("long").alias(f"_c_{v}") for v in values])
    zero = [F.lit(0).cast("long").alias("_n"),
            *[F.lit(0).cast(dec).alias(f"_s_{v}") for v in values],
            *[F.lit(0).cast("long").alias(f"_c_{v}") for v in values]]
    p_us = epoch_us(point_ts)
    probes = (points.select(F.col(point_id).alias("_pid"), p_us.alias("_hi"))
              .select(F.explode(F.array(
                  F.struct(F.col("_hi").alias("_t"), F.lit("hi").alias("_end")),
                  F.struct((F.col("_hi") - horizon_seconds * 1_000_000).alias("_t"), F.lit("lo").alias("_end")))
              ).alias("_p"), "_pid")
              .select(F.col("_p._t").alias("_t"), F.lit(1).alias("_side"), F.col("_p._end").alias("_end"),
                      F.xxhash64("_pid").alias("_tie"), "_pid", *zero))
    both = with_segment(ev.unionByName(probes), [], ["_t", "_side", "_tie"], partitions)
    acc = ["_n", *[f"_s_{v}" for v in values], *[f"_c_{v}" for v in values]]

    # Totals of the segments -> total of all earlier segments: a row per partition.
    totals = summarised(both, *[F.sum(a).alias(a) for a in acc])
    earlier = Window.partitionBy(KEY).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(KEY, SEGMENT, "_rows", *[F.coalesce(F.sum(a).over(earlier), F.lit(0).cast(totals.schema[a].dataType))
                                                    .alias(f"_pre{a}") for a in acc])

    # Running sums inside each segment; events sort before probes at equal time.
    w = in_segment(["_t", "_side", "_tie"]).rowsBetween(Window.unboundedPreceding, 0)
    run = both.select(KEY, SEGMENT, "_side", "_end", "_pid", *[F.sum(a).over(w).alias(a) for a in acc],
                      F.count(F.lit(1)).over(in_segment()).alias("_met")).where(F.col("_side") == 1)
    run = joined(run, F.broadcast(before))     # one row per partition
    sign = F.when(F.col("_end") == "hi", 1).otherwise(-1)
    prefix = run.select("_pid", *[(sign * (F.col(a) + F.col(f"_pre{a}"))).alias(a) for a in acc])
    win = prefix.groupBy("_pid").agg(*[F.sum(a).alias(a) for a in acc])
    out = win.select(F.col("_pid").alias(point_id), F.col("_n").alias("n_events"),
                     *[F.when(F.col(f"_c_{v}") > 0, F.col(f"_s_{v}").cast("double")).alias(f"{v}_sum")
                       for v in values])
    return points.join(out, point_id, "left")
