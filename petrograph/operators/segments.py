"""Segments: consecutive pieces of a global order, one per range partition.

Ordered operators (previous / next row, as-of, trailing sums, throttle) are segmented scans:

1. rows are range-partitioned on the operator's whole order (keys, time, tie-break), so a busy key, a
   burst and even a group of rows at one instant are spread over as many partitions as they need;
2. each (key, segment) is one window partition;
3. each (key, segment) gives one summary row (its last row, its first row, its sums), and a window over
   the summaries alone tells each segment what comes before (or after) it.

Nothing is counted or sampled by the library and no job runs before the action.  The summaries hold
a row per key and one more for each partition that a key spans.

Steps 2 and 3 must see the same segments.  Spark draws a range exchange's bounds anew for each exchange,
so both have to read one and the same.  Rows are therefore packed into a single column before the
exchange: whatever columns the two branches go on to use, the plan below it is the same and Spark
reuses the exchange.  ``checked`` makes sure of it: each segment's summary carries the number of its rows
and the window the number of rows it met; where they differ the query fails instead of
returning a wrong row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY, SEGMENT = "_key", "_segment"
ROWS = "_rows"


def with_segment(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """df range-partitioned by (keys, order), with ``_key`` = struct(keys) and ``_segment`` = the partition's number.

    Segment numbers rise with the order.  ``partitions`` defaults to spark.sql.shuffle.partitions; it is
    passed on as a number, so adaptive execution doesn't merge segments.  Structs of keys are never
    NULL and compare NULL fields as equal, so NULL keys meet in windows, aggregates and joins alike.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.col(c).alias(f"_o{i}") for i, c in enumerate([*keys, *order])]
    # An array of one struct: Catalyst prunes fields of a struct below an exchange, but not through element_at.
    packed = df.select(*sort, F.array(F.struct(*[F.col(c) for c in df.columns])).alias("_packed"))
    row = F.element_at("_packed", 1)
    key = F.struct(*[row[k].alias(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    return (packed.repartitionByRange(n, *[f"_o{i}" for i in range(len(sort))])
            .select(*[row[c].alias(c) for c in df.columns], key.alias(KEY), F.spark_partition_id().alias(SEGMENT)))


def in_segment(order: list[str] | None = None) -> Window:
    w = Window.partitionBy(KEY, SEGMENT)
    return w.orderBy(*order) if order else w


def summarised(segmented: DataFrame, *aggregates: Column) -> DataFrame:
    """One row per (key, segment): the aggregates and the number of rows."""
    return segmented.groupBy(KEY, SEGMENT).agg(*aggregates, F.count(F.lit(1)).alias(ROWS))


def carried(summaries: DataFrame, value: str, backward: bool, name: str) -> DataFrame:
    """summaries plus the nearest earlier (later) segment's ``value`` of the same key, nulls skipped."""
    w = Window.partitionBy(KEY).orderBy(SEGMENT)
    near = (F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) if backward
            else F.first(value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    return summaries.select(KEY, SEGMENT, ROWS, near.alias(name))


def joined(windowed: DataFrame, summaries: DataFrame) -> DataFrame:
    """windowed (with ``_met`` = rows of its segment) and its segments' summaries, which must agree on the rows."""
    both = windowed.join(summaries, [KEY, SEGMENT], "left")
    same = F.col("_met").eqNullSafe(F.col(ROWS))
    return both.filter(F.when(same, True).otherwise(
        F.raise_error(F.lit("segments of one order differ between scans")).cast("boolean")))
