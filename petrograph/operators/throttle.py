"""Greedy throttle per key (T5): the first event passes, then events are
dropped until ``limit`` has elapsed since the last one that passed.

The rule is sequential, and a per-key loop would put a hot key's whole history
in one task.  Instead rows are range-partitioned by (key, time, tie) and:

1. every partition is read once and sums up its effect.  An event at least
   ``limit`` after the one before it passes whatever came earlier, so only a partition that is one
   key without such a gap depends on what passed before it.  Its effect is a step function
   from "last pass before" to "last pass in it", tabulated by the events that may be the first to pass;
   chains from different events merge as they meet, so one pass and one queue make the table;
2. the partitions' effects are composed in order.  Only the first key of a partition can have begun
   earlier, so this gives one number for each partition;
3. those numbers (one row per partition: a bounded broadcast) go back to the partitions, which are read
   once more and keep the events that pass.

Both readings use one range exchange (see ``segments``); each partition checks that it is the one that
was summed up.  Nothing is materialised, and no job runs before the action.

Events without a time don't pass; a NULL key is a key of its own; with ``limit`` 0 all others pass.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrograph.operators.timeseries import epoch_us
from petrograph.plans.registry import query
from petrograph.sources.tables import read_table

#: Header rows (step null) and table rows of a partition's effect.
EFFECT = pa.schema([("segment", pa.int32()), ("n", pa.int64()), ("first_key", pa.binary()), ("last_key", pa.binary()),
                    ("open", pa.bool_()), ("last_pass", pa.int64()), ("entry", pa.int64()), ("end", pa.int64())])
CARRY = pa.schema([("_segment", pa.int32()), ("_n", pa.int64()), ("_carry", pa.int64())])


def _runs(key: pa.Array, t: np.ndarray, limit: int, before: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """(new key, certain pass) of each row; ``before`` is the last row's (key, time), None at the start."""
    n = len(t)
    new = np.empty(n, dtype=bool)
    new[0] = before is None or key[0].as_py() != before[0]
    if n > 1:
        same = pc.equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
        new[1:] = ~same.astype(bool)
    gap = np.empty(n, dtype=bool)
    gap[0] = before is not None and t[0] - before[1] >= limit
    gap[1:] = t[1:] - t[:-1] >= limit
    return new, new | gap


def _passes(t: np.ndarray, certain: np.ndarray, limit: int, last: int | None) -> tuple[np.ndarray, int]:
    """Which rows pass, and the time of the last pass; ``last`` is the one before these rows (None: no such)."""
    out = certain.copy()
    starts = np.flatnonzero(certain)
    if not len(starts) or starts[0] > 0:
        starts = np.concatenate(([0], starts))
    ends = np.concatenate((starts[1:], [len(t)]))
    # Only stretches of at least the limit hold more passes than their first row's.
    hops = (t[ends - 1] - t[starts] >= limit) | (~certain[starts])
    for begin, end in zip(starts[hops].tolist(), ends[hops].tolist(), strict=True):
        if certain[begin]:
            at, now = begin, int(t[begin])
        else:
            at = begin if last is None else begin + int(np.searchsorted(t[begin:end], last + limit))
            if at >= end:
                continue
            out[at], now = True, int(t[at])
        while True:
            at += int(np.searchsorted(t[at:end], now + limit))
            if at >= end:
                break
            out[at], now = True, int(t[at])
    passed = np.flatnonzero(out)
    return out, int(t[passed[-1]]) if len(passed) else last


class _Chains:
    """Chains of passes from every event that may be a partition's first to pass, merged as they meet."""

    def __init__(self, limit: int):
        self.limit = limit
        self.entries: list[int] = []
        self.states: deque[tuple[int, list[int]]] = deque()     # last pass, entries; ascending
        self.undecided = True

    def add(self, times: np.ndarray) -> None:
        for t in times.tolist():
            if self.entries and self.entries[-1] == t:
                continue
            merged: list[int] = []
            while self.states and self.states[0][0] + self.limit <= t:
                old = self.states.popleft()[1]
                merged, old = (merged, old) if len(merged) >= len(old) else (old, merged)
                merged.extend(old)
            if self.undecided:
                # What came before passed no later than the first event: no entry lies beyond its limit but one.
                self.undecided = not self.entries or t < self.entries[0] + self.limit
                merged.append(len(self.entries))
                self.entries.append(t)
            if merged:
                self.states.append((t, merged))

    def table(self) -> list[tuple[int, int]]:
        """(entry, last pass), ascending; neighbours of one end as the last of them."""
        ends = np.empty(len(self.entries), dtype=np.int64)
        for last, entries in self.states:
            ends[entries] = last
        keep = np.ones(len(ends), dtype=bool)
        keep[:-1] = ends[:-1] != ends[1:]
        return [(e, int(z)) for e, z, k in zip(self.entries, ends, keep, strict=True) if k]


def _effect(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, n, first, before, last = None, 0, None, None, None
        chains = _Chains(limit)
        for b in batches:
            if not b.num_rows:
                continue
            key, t = b.column("_k"), b.column("_t").to_numpy()
            if segment is None:
                segment, first = b.column("_segment")[0].as_py(), key[0].as_py()
            fresh, certain = _runs(key, t, limit, before)
            if n == 0:
                certain[0] = False      # what came before this partition isn't known here
            if chains is not None and certain.any():
                chains = None
            if chains is not None:
                chains.add(t)
            else:
                at = int(np.flatnonzero(certain)[-1]) if certain.any() else 0
                last = _passes(t[at:], certain[at:], limit, last)[1]
            n += b.num_rows
            before = (key[b.num_rows - 1].as_py(), int(t[-1]))
        if segment is None:
            return
        rows = [(segment, n, first, before[0], chains is not None, last, None, None)]
        rows += [(segment, n, None, None, None, None, *step) for step in (chains.table() if chains else [])]
        for begin in range(0, len(rows), 10_000):
            part = rows[begin:begin + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*part, strict=True), EFFECT, strict=True)],
                                             schema=EFFECT)
    return run


def _composed(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = last = None
        known = pending = waiting = False
        for b in batches:
            out = []
            for row in b.to_pylist():
                if row["entry"] is None:
                    known = known and row["first_key"] == key
                    out.append((row["segment"], row["n"], last if known else None))
                    key, pending = row["last_key"], row["open"]
                    waiting = known
                    if not row["open"]:
                        known, last = True, row["last_pass"]
                elif pending and (not waiting or row["entry"] >= last + limit):
                    # The first step that fits; without any, nothing passes and the last pass stays.
                    known, last, pending = True, row["end"], False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), CARRY, strict=True)],
                                                 schema=CARRY)
    return run


def _kept(limit: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, expected, before, last = 0, 0, None, None
        for b in batches:
            if not b.num_rows:
                continue
            key, t = b.column("_k"), b.column("_t").to_numpy()
            fresh, certain = _runs(key, t, limit, before)
            if n == 0:
                expected, last = b.column("_n")[0].as_py(), b.column("_carry")[0].as_py()
                certain[0] = last is None
            out, last = _passes(t, certain, limit, last)
            n += b.num_rows
            before = (key[b.num_rows - 1].as_py(), int(t[-1]))
            yield b.filter(pa.array(out)).select(schema.names)
        if n != expected:
            raise ValueError("segments of one order differ between scans")
    return run


def throttle(df: DataFrame, key: str, limit_seconds: int, ts: str = "ts", tie: str = "id",
             partitions: int | None = None) -> DataFrame:
    """The rows of df that pass; ``partitions`` defaults to spark.sql.shuffle.partitions."""
    timed = df.where(F.col(ts).isNotNull())
    if limit_seconds <= 0:
        return timed
    limit = limit_seconds * 1_000_000
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The key as bytes: one type for the tasks, NULL as a value of its own.
    name = F.encode(F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")), "utf-8")
    rows = (timed.withColumn("_k", name).withColumn("_t", epoch_us(ts))
            .repartitionByRange(n, "_k", "_t", tie).sortWithinPartitions("_k", "_t", tie)
            .withColumn("_segment", F.spark_partition_id()))
    effect = rows.mapInArrow(_effect(limit), "segment int, n long, first_key binary, last_key binary, open boolean, "
                                             "last_pass long, entry long, end long")
    carry = (effect.repartition(1).sortWithinPartitions("segment", F.asc_nulls_first("entry"))
             .mapInArrow(_composed(limit), "_segment int, _n long, _carry long"))
    names = pa.schema([(c, pa.null()) for c in df.columns])
    # A join keeps the order of its streamed side; the sort only makes sure of it.
    return (rows.join(F.broadcast(carry), "_segment").sortWithinPartitions("_k", "_t", tie)
            .mapInArrow(_kept(limit, names), df.schema))


@query("throttle_events", "T5", sql="""
WITH RECURSIVE e AS (SELECT event_id AS id, user_id, ts, value FROM events),
u AS (SELECT user_id, ts + INTERVAL 3600 SECOND AS t, 0 AS side, id AS pid, CAST(NULL AS BIGINT) AS eid FROM e
      UNION ALL SELECT user_id, ts, 1, NULL, id FROM e),
nx AS (SELECT pid AS id, nxt FROM (
         SELECT side, pid, first_value(eid IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, side, eid
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM u) w WHERE side = 0),
firsts AS (SELECT arg_min(id, (ts, id)) AS id FROM e GROUP BY user_id),
chain(id) AS (SELECT id FROM firsts
              UNION ALL SELECT nx.nxt FROM chain JOIN nx ON nx.id = chain.id WHERE nx.nxt IS NOT NULL)
SELECT e.* FROM e JOIN chain USING (id)""")
def throttle_events(spark: SparkSession, d: str, limit_seconds: int = 3600) -> DataFrame:
    """Per user: keep an event only when an hour has passed since the last kept one."""
    e = read_table(spark, d, "events", "event_id", "user_id", "ts", "value").withColumnRenamed("event_id", "id")
    return throttle(e, "user_id", limit_seconds)
