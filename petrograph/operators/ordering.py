"""Per-group "row with the largest (smallest) order" aggregates that stay
hash-based.

``max_by(struct(values), struct(ts, id))`` keeps structs in its aggregation
buffer, which Spark can only run as a ``SortAggregate``: even the partial
(map-side) step sorts every input partition.  When the order is a timestamp
plus an integral tie-break and the values are primitive, the order is
encoded as one DECIMAL(38,0) - microseconds * 10^20 + (id + 2^63), monotone
in (ts, id) - and each value gets its own ``max_by(value, number)``.  Those
buffers are fixed-width, so the plan is a ``HashAggregate`` with partial
aggregation.  Anything else falls back to the struct form.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PRIMITIVE = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
              T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType)
_TIME = (T.TimestampType, T.TimestampNTZType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def order_number(df: DataFrame, order: list[str]) -> Column | None:
    """(timestamp, integral id) -> DECIMAL(38,0) with the same order, else None."""
    if len(order) != 2:
        return None
    ts_t, id_t = df.schema[order[0]].dataType, df.schema[order[1]].dataType
    if not isinstance(ts_t, _TIME) or not isinstance(id_t, _INTEGRAL):
        return None
    from petrograph.operators.timeseries import epoch_us

    return encode_order(epoch_us(order[0]), F.col(order[1]))


def encode_order(us: Column, tie: Column) -> Column:
    """(microseconds, integral tie) -> DECIMAL(38,0) in the same lexicographic order."""
    shifted = tie.cast("decimal(20,0)") + F.lit(Decimal(2 ** 63)).cast("decimal(20,0)")
    return us.cast("decimal(20,0)") * F.lit(Decimal(10 ** 20)).cast("decimal(21,0)") + shifted


def is_primitive(dt: T.DataType) -> bool:
    return isinstance(dt, _PRIMITIVE)


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, _INTEGRAL)


def extreme_row(df: DataFrame, keys: list[str], order: list[str], values: list[str],
                largest: bool = True, alias: str = "_edge") -> DataFrame:
    """Per ``keys``: struct(values) of the row with the largest (smallest) ``order``."""
    num = order_number(df, order)
    primitive = all(isinstance(df.schema[v].dataType, _PRIMITIVE) for v in values)
    pick = F.max_by if largest else F.min_by
    if num is None or (not primitive and not keys):
        # (a global aggregate without keys needs no sort even in this form)
        agg = pick(F.struct(*[F.col(v) for v in values]), F.struct(*[F.col(o) for o in order]))
        return df.groupBy(*keys).agg(agg.alias(alias)) if keys else df.agg(agg.alias(alias))
    if not primitive:
        # Non-primitive values (strings): each key's winning order number by a
        # hash aggregate, then an equi-join back ((ts, id) is unique, so one
        # row per key matches).  Two hash passes instead of a sort.
        tagged = df.withColumn("_onum", num)
        best = F.max("_onum") if largest else F.min("_onum")
        win = tagged.groupBy(*keys).agg(best.alias("_onum"))
        rows = (tagged.join(win, [*keys, "_onum"])
                .select(*keys, F.struct(*[F.col(v) for v in values]).alias(alias)))
        return win.select(*keys).join(rows, keys, "left")
    tagged = df.withColumn("_onum", num)
    aggs = [pick(F.col(v), F.col("_onum")).alias(f"_x_{i}") for i, v in enumerate(values)]
    grouped = tagged.groupBy(*keys).agg(*aggs) if keys else tagged.agg(*aggs)
    return grouped.select(*keys, F.struct(*[F.col(f"_x_{i}").alias(v) for i, v in enumerate(values)])
                          .alias(alias))


def edge_value(df: DataFrame, order: list[str], values: list[str], largest: bool = True,
               where: Column | None = None) -> list[Column]:
    """Aggregates ``_x0``, ``_x1``, ...: each value of the row with the largest (smallest) order, of those ``where`` holds.

    Hash-based where the order can be encoded and the values are primitive, else over structs.
    """
    num = order_number(df, order)
    if num is None or not all(is_primitive(df.schema[v].dataType) for v in values):
        num = F.struct(*[F.col(o) for o in order])
    num = num if where is None else F.when(where, num)
    pick = F.max_by if largest else F.min_by
    return [pick(F.col(v), num).alias(f"_x{i}") for i, v in enumerate(values)]
