"""Order-dependent operators over time series: previous / next row per key,
price change, current price, debounce (K4-K6, D5, T4) and a distributed
zero-based ordinal (G5's building block).

A window ``partitionBy(key)`` puts a whole key in one task, and a key may hold
a third of all rows.  ``neighbour`` therefore runs over segments of the global
order (see ``segments``): each (key, segment) is one window partition, and the
first row of a segment is seeded from the last row of the nearest earlier
segment of its key (or the last from the first of the nearest later one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from petrograph.functions import exprs as X
from petrograph.functions import sqltext as Q
from petrograph.operators.ordering import edge_value, extreme_row
from petrograph.operators.segments import carried, in_segment, joined, summarised, with_segment
from petrograph.plans.registry import query
from petrograph.plans.storage import cut_lineage
from petrograph.sources.tables import read_table
from petrograph.sources.views import v_price

def neighbour(df: DataFrame, keys: list[str], order: list[str], values: list[str],
              direction: str = "prev", prefix: str | None = None, partitions: int | None = None) -> DataFrame:
    """Add ``<prefix><v>`` = value of the previous (next) row of the same key.

    Equivalent to ``lag``/``lead`` over ``partitionBy(keys).orderBy(order)``
    where ``order[0]`` is the timestamp, as a segmented scan.
    """
    if direction not in ("prev", "next"):
        raise ValueError(direction)
    back = direction == "prev"
    prefix = prefix or ("prev_" if back else "next_")
    rows = with_segment(df, keys, order, partitions)
    vals = F.struct(*[F.col(v) for v in values])
    near = F.lag(vals) if back else F.lead(vals)
    inner = rows.withColumn("_near", near.over(in_segment(order))).withColumn("_met", F.count(F.lit(1)).over(in_segment()))
    edges = summarised(rows, *edge_value(rows, order, values, largest=back))
    edges = edges.withColumn("_edge", F.struct(*[F.col(f"_x{i}").alias(v) for i, v in enumerate(values)]))
    filled = F.coalesce(F.col("_near"), F.col("_seed"))
    return (joined(inner, carried(edges, "_edge", back, "_seed"))
            .select(*df.columns, *[filled[v].alias(prefix + v) for v in values]))


def price_changes(prices: DataFrame) -> DataFrame:
    """absolute = new - prev (2 dp); percentage = (new - prev) / prev * 100 (2 dp),
    both from the unrounded difference; NULL for a series' first tick."""
    with_prev = neighbour(prices, ["price_type"], ["ts", "id"], ["price"])
    diff = F.col("price") - F.col("prev_price")
    return with_prev.select(
        "id", "ts", "price_type", "price", "prev_price",
        X.round_fixed(diff, 2).alias("change_abs"),
        X.round_fixed(F.try_divide(diff, F.col("prev_price")) * 100, 2).alias("change_pct"))


_CHANGE_SQL = f"""
SELECT id, ts, price_type, price, prev_price,
       {Q.round_fixed('price - prev_price', 2)} AS change_abs,
       {Q.round_fixed('(price - prev_price) / prev_price * 100', 2)} AS change_pct
FROM (SELECT *, lag(price) OVER (PARTITION BY price_type ORDER BY ts, id) AS prev_price FROM v_price) p"""


@query("price_change", "K5", sql=_CHANGE_SQL)
def price_change(spark: SparkSession, d: str) -> DataFrame:
    return price_changes(v_price(spark, d))


@query("price_direction", "D5", sql=f"""
SELECT id, price_type, CASE WHEN {Q.or_zero('change_pct')} >= 0 THEN 'up' ELSE 'down' END AS direction,
       (CASE WHEN {Q.or_zero('change_pct')} >= 0 THEN '+' ELSE '' END) || {Q.to_fixed(Q.or_zero('change_pct'), 2)} || '%'
         AS change_text
FROM ({_CHANGE_SQL}) c""")
def price_direction(spark: SparkSession, d: str) -> DataFrame:
    """Zero counts as up; a missing change shows as +0.00%."""
    pct = X.or_zero("change_pct")
    up = pct >= 0
    return price_changes(v_price(spark, d)).select(
        "id", "price_type", F.when(up, "up").otherwise("down").alias("direction"),
        F.concat(F.when(up, "+").otherwise(""), X.to_fixed(pct, 2), F.lit("%")).alias("change_text"))


def latest_two(df: DataFrame, keys: list[str], order: list[str], values: list[str],
               few_keys: bool = False) -> DataFrame:
    """Latest row per key plus the row before it, by two partial aggregations.

    Cheaper than a window: no sort of the series, one candidate per key per
    task in each shuffle.  The per-key table joined back has one row per key.
    With ``few_keys`` (the key's domain is a fixed short list) it is broadcast
    and no row of df is shuffled; otherwise keys may be many and AQE decides
    by its measured size.
    """
    ordkey = F.struct(*order)
    last = extreme_row(df, keys, order, [*order, *values], alias="_last")
    lk = last.select(*keys, F.col("_last").alias("_l"))
    lk = F.broadcast(lk) if few_keys else lk
    earlier = df.join(lk, keys).where(ordkey < F.struct(*[F.col(f"_l.{o}") for o in order]))
    before = extreme_row(earlier, keys, order, [*order, *values], alias="_prev")
    return (last.join(F.broadcast(before) if few_keys else before, keys, "left")
            .select(*keys, *[F.col(f"_last.{c}").alias(c) for c in [*order, *values]],
                    *[F.col(f"_prev.{v}").alias(f"prev_{v}") for v in values]))


@query("current_price", "K4", sql=f"""
WITH c AS ({_CHANGE_SQL})
SELECT price_type, arg_max(id, (ts, id)) AS id, arg_max(ts, (ts, id)) AS ts, arg_max(price, (ts, id)) AS price,
       arg_max(change_abs, (ts, id)) AS change_abs, arg_max(change_pct, (ts, id)) AS change_pct
FROM c GROUP BY price_type""")
def current_price(spark: SparkSession, d: str) -> DataFrame:
    """Latest price per price type with its change vs. the tick before it."""
    # v_price maps every priority to one of three price types, so the latest rows are three at most.
    t = latest_two(v_price(spark, d), ["price_type"], ["ts", "id"], ["price"], few_keys=True)
    diff = F.col("price") - F.col("prev_price")
    return t.select("price_type", "id", "ts", "price",
                    X.round_fixed(diff, 2).alias("change_abs"),
                    X.round_fixed(F.try_divide(diff, F.col("prev_price")) * 100, 2).alias("change_pct"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events", "event_id", "user_id", "ts", "value").withColumnRenamed("event_id", "id")


@query("event_previous_value", "K6", sql="""
SELECT event_id AS id, user_id, ts, value,
       lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_value FROM events""")
def event_previous_value(spark: SparkSession, d: str) -> DataFrame:
    """``usePrevious`` per user: the prior value, NULL for the first."""
    return neighbour(_events(spark, d), ["user_id"], ["ts", "id"], ["value"])


def debounce(df: DataFrame, key: str, wait_seconds: int, ts: str = "ts", tie: str = "id",
             partitions: int | None = None) -> DataFrame:
    """Keep the last event of each burst: the next event of the key is absent
    or comes ``wait_seconds`` or more later (a call landing before the timer
    fires resets it)."""
    nxt = neighbour(df, [key], [ts, tie], [ts], direction="next", partitions=partitions)
    gap_us = F.timestamp_diff("MICROSECOND", F.col(ts), F.col(f"next_{ts}"))
    return nxt.where(F.col(f"next_{ts}").isNull() | (gap_us >= wait_seconds * 1_000_000)).drop(f"next_{ts}")


@query("debounce_events", "T4", sql="""
SELECT id, user_id, ts, value FROM (
  SELECT event_id AS id, user_id, ts, value,
         lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nts FROM events) x
WHERE nts IS NULL OR epoch_us(nts) - epoch_us(ts) >= 300 * 1000000""")
def debounce_events(spark: SparkSession, d: str, wait_seconds: int = 300) -> DataFrame:
    return debounce(_events(spark, d), "user_id", wait_seconds)


def ordinal_index(df: DataFrame, order: list[Column], out: str = "ordinal",
                  partitions: int | None = None) -> DataFrame:
    """Zero-based position of every row in ``order`` without a global window.

    1. range-partition on the order and sort within partitions;
    2. tag each row with its partition and position inside it (from
       ``monotonically_increasing_id``, whose upper bits are the partition);
    3. cut lineage (reliable checkpoint) so both passes see one assignment;
    4. per-partition counts (one row per partition) -> running offsets ->
       broadcast back (bounded by the partition count).
    Unique order keys are required for a deterministic result.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    tagged = cut_lineage(ranged.withColumn("_p", F.spark_partition_id())
                         .withColumn("_m", F.monotonically_increasing_id()))
    counts = tagged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_off"))
    local = F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33)
    return (tagged.join(F.broadcast(offs), "_p")
            .withColumn(out, (F.col("_off") + local).cast("long"))
            .drop("_p", "_m", "_off"))
