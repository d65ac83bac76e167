"""Per-key event-time order on a stream: rows wait in state and are handed on, sorted, behind the watermark.

``transformWithState`` on the RocksDB store.  A key's rows wait in a map from time slot to rows, with one
event-time timer per slot.  When the watermark passes a slot's end no row of it can arrive any more
(later ones are dropped and counted by Spark), so its rows are sorted by (time, id) and folded into the
key's carried value.  The result therefore doesn't depend on the order in which files are read, nor on
where micro-batches are cut.  A task holds one slot of one key; all else is in the store.

``Ordered`` is the frame; what is computed is its ``fold``: (carried value or None, sorted rows) ->
(new carried value, rows to emit).  ``idle_ms`` clears the carried value once the watermark has passed it
by that much, for folds that no longer depend on it then.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: us: microseconds since the epoch; the key and the values follow by name.
Fold = Callable[[tuple | None, pd.DataFrame], tuple[tuple, pd.DataFrame]]


class Ordered(StatefulProcessor):
    """Releases each key's rows in (us, id) order, slot by slot."""

    def __init__(self, fold: Fold, carried: str, value: str, slot_ms: int, idle_ms: int | None = None):
        self.fold, self.carried, self.value = fold, carried, value
        self.slot_ms, self.idle_ms = slot_ms, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.carried)
        self.waiting = handle.getMapState("waiting", "slot long",
                                          f"us array<long>, id array<long>, value array<{self.value}>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            real = pdf[pdf["id"].notna()]           # heartbeats have no id
            if len(real):
                for slot, part in real.groupby(real["us"] // (self.slot_ms * 1000)):
                    slot = int(slot)
                    old = self.waiting.getValue((slot,)) if self.waiting.containsKey((slot,)) else None
                    if old is None:
                        self.handle.registerTimer((slot + 1) * self.slot_ms)
                        old = ([], [], [])
                    self.waiting.updateValue((slot,), tuple(
                        [*had, *part[c].tolist()] for had, c in zip(old, ("us", "id", "value"), strict=True)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        slot = (at // self.slot_ms - 1,)
        out = None
        if at % self.slot_ms == 0 and self.waiting.containsKey(slot):
            us, ids, values = self.waiting.getValue(slot)
            self.waiting.removeKey(slot)
            pdf = pd.DataFrame({"us": us, "id": ids, "value": values}).sort_values(["us", "id"], kind="mergesort",
                                                                                   ignore_index=True)
            before = self.last.get() if self.last.exists() else None
            after, out = self.fold(before, pdf)
            self.last.update(after)
            if self.idle_ms is not None:
                # The fold's first carried field is a time in microseconds.
                self.handle.registerTimer(-(-after[0] // 1000) + self.idle_ms)
        if self.idle_ms is not None and self.last.exists() and -(-self.last.get()[0] // 1000) + self.idle_ms <= at:
            self.last.clear()
        return iter([out.assign(key=key[0])[["key", *out.columns]]] if out is not None and len(out) else [])

    def close(self) -> None:
        pass


def in_event_order(rows: DataFrame, fold: Fold, carried: str, value: str, output: str, slot_ms: int,
                   idle_ms: int | None = None) -> DataFrame:
    """Stream of (key, ``output``) from a watermarked stream of (key, us, id, value, event_time)."""
    use_rocks_db(rows.sparkSession)
    key = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").transformWithStateInPandas(
        Ordered(fold, carried, value, slot_ms, idle_ms), T._parse_datatype_string(f"key {key}, {output}"), "Append", "EventTime")


def use_rocks_db(spark: SparkSession) -> None:
    spark.conf.set(STATE_STORE, ROCKS_DB)


# -- folds -------------------------------------------------------------------------------------
def round_fixed(x: np.ndarray, n: int) -> np.ndarray:
    p = 10 ** n
    return np.sign(x) * np.floor(np.abs(x) * p + 0.5) / p


def chained_changes(before: tuple | None, pdf: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    """Each tick's change against the tick before it; the carried value is the last price."""
    price = pdf["value"].to_numpy(dtype="float64")
    prev = np.concatenate(([np.nan if before is None else before[0]], price[:-1]))
    with np.errstate(divide="ignore", invalid="ignore"):
        pct = np.where(prev == 0, np.nan, (price - prev) / prev * 100)
    out = pd.DataFrame({"us": pdf["us"], "id": pdf["id"], "price": price, "prev_price": prev,
                        "change_abs": round_fixed(price - prev, 2), "change_pct": round_fixed(pct, 2)})
    return (float(price[-1]),), out


def throttled(limit_us: int) -> Fold:
    """Rows at least ``limit_us`` after the last one that passed; the carried value is its time."""
    def fold(before: tuple | None, pdf: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        t = pdf["us"].to_numpy(dtype="int64")
        at = 0 if before is None else int(np.searchsorted(t, before[0] + limit_us))
        passed = []
        while at < len(t):
            passed.append(at)
            at = max(int(np.searchsorted(t, t[at] + limit_us)), at + 1)
        last = int(t[passed[-1]]) if passed else before[0]
        return (last,), pdf.iloc[passed][["us", "id", "value"]].reset_index(drop=True)
    return fold


def heartbeats_as(beats: DataFrame, like: DataFrame, event_time: str = "event_time") -> DataFrame:
    """Heartbeat rows (event_time) with the columns of ``like``, all else NULL."""
    return beats.select(*[F.col("event_time").alias(c) if c == event_time else F.lit(None).cast(f.dataType).alias(c)
                          for c, f in ((f.name, f) for f in like.schema)])


def micros(event_time: str | Column) -> Column:
    return F.unix_micros(F.col(event_time) if isinstance(event_time, str) else event_time)
