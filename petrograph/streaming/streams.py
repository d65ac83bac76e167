"""Structured Streaming twins of the batch operators.

A stream job lives in one folder: sink, checkpoint and heartbeats (``job``).  Started again with the same
folder it goes on where it stopped; the Parquet sink's own log makes each micro-batch count once.

Windows, sessions and ordered state emit only what the watermark has closed, so a table read as a file
stream would keep its last rows back.  ``finish`` ends such an input: it puts a heartbeat (an event
time and nothing else) into the job's heartbeat folder, which every stateful stream reads beside its
events, and runs the job again from its checkpoint.  The heartbeat moves the watermark past all
events; no operator emits a row for it.

How late a row may be is the watermark's delay.  A table's files hold their rows in no order of time, so
the registered queries allow for all of it (``BACKFILL``); a live source has minutes.  Rows beyond the
delay are dropped and counted: ``dropped_rows`` of a run.  On a live source the same stream builders run
with a processing-time trigger.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrograph.functions import exprs as X
from petrograph.functions import sqltext as Q
from petrograph.plans.registry import query
from petrograph.plans.storage import scratch_path
from petrograph.sources.tables import table_path
from petrograph.sources.views import event_view, tick_view
from petrograph.streaming.ordered import (chained_changes, heartbeats_as, in_event_order, micros, throttled,
                                          use_rocks_db)

BACKFILL = "36500 days"         # watermark delay that no file order can exceed
END_OF_INPUT = "2260-01-01"     # event time of the heartbeat that ends an input (pandas knows no later century)
HOUR_MS = 3_600_000


def events_stream(spark: SparkSession, d: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The events table as a file stream (schema taken from the table, not inferred).

    ``max_files_per_trigger`` only bounds the rows of a micro-batch; no result depends on it.
    """
    path = table_path(d, "events")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    # A file stream reads folders: the table's own, or the one around its single file.
    return r.parquet(path) if folder else r.option("pathGlobFilter", "events.parquet").parquet(d)


@dataclass
class Job:
    """Folders and figures of one stream job."""

    spark: SparkSession
    root: str
    runs: int = 0
    dropped_rows: int = 0       # rows behind the watermark, over all runs of this object
    state_rows: list[int] = field(default_factory=list)     # state size after each micro-batch

    @property
    def sink(self) -> str:
        return f"{self.root}/sink"

    def heartbeats(self) -> DataFrame:
        """Stream of heartbeats: event_time."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/heartbeats")
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(folder)
        return self.spark.readStream.schema("event_time timestamp").parquet(f"{self.root}/heartbeats")

    def run(self, stream: DataFrame) -> DataFrame:
        """Drain what is there into the sink (append mode); the sink so far."""
        use_rocks_db(self.spark)
        q = (stream.writeStream.option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True)
             .format("parquet").option("path", self.sink).outputMode("append").start())
        q.awaitTermination()
        if q.exception():
            raise q.exception()
        for progress in q.recentProgress:
            for op in progress["stateOperators"]:
                self.dropped_rows += op["numRowsDroppedByWatermark"]
            self.state_rows.append(sum(op["numRowsTotal"] for op in progress["stateOperators"]))
        self.runs += 1
        return self.spark.read.schema(stream.schema).parquet(self.sink)

    def finish(self, stream: DataFrame) -> DataFrame:
        """Drain, end the input and drain again: the complete result."""
        self.run(stream)
        (self.spark.range(1).select(F.lit(END_OF_INPUT).cast("timestamp").alias("event_time"))
         .write.mode("append").parquet(f"{self.root}/heartbeats"))
        return self.run(stream)


def job(spark: SparkSession, name: str, root: str | None = None) -> Job:
    """The job in ``root``, or a new one below the shared folder."""
    return Job(spark, root or scratch_path(spark, name))


def timed(rows: DataFrame, beats: DataFrame, delay: str) -> DataFrame:
    """rows (with a zone-less ``ts``) and heartbeats as one watermarked stream on ``event_time``.

    Columns are nullable in every micro-batch's plan, whichever of the two sources had rows in it: they
    may become part of the state's schema, which must stay the same.
    """
    time = F.col("ts").cast("timestamp")
    with_time = rows.select(*[F.when(time.isNotNull(), F.col(c)).alias(c) for c in rows.columns], time.alias("event_time"))
    return with_time.unionByName(heartbeats_as(beats, with_time)).withWatermark("event_time", delay)


# -- T2 / T3: stateless -------------------------------------------------------------------
def live_feed(events: DataFrame) -> DataFrame:
    ev = event_view(events)
    return ev.select("id", "ts", "severity", X.severity_band("severity").alias("severity_colour"),
                     "immediate", X.impact_band("immediate").alias("impact_band"),
                     X.pct_text("immediate", 0).alias("impact_pct"))


@query("stream_live_feed", "T2", sql=f"""
SELECT id, ts, severity, {Q.severity_band('severity')} AS severity_colour, immediate,
       {Q.impact_band('immediate')} AS impact_band, {Q.pct_text('immediate', 0)} AS impact_pct FROM v_event""")
def stream_live_feed(spark: SparkSession, d: str) -> DataFrame:
    """Live event monitoring: every event with its severity and impact bands."""
    return job(spark, "live-feed").run(live_feed(events_stream(spark, d)))


def alerts(events: DataFrame) -> DataFrame:
    ev = event_view(events)
    return (ev.where((F.col("severity") == "critical") | (F.col("immediate") > 0.7))
            .select("id", "ts", "title", "severity", "immediate"))


@query("stream_alerts", "T3", sql="""
SELECT id, ts, title, severity, immediate FROM v_event WHERE severity = 'critical' OR immediate > 0.7""")
def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    """High-impact alerts (ours): critical severity or immediate impact above 0.7."""
    return job(spark, "alerts").run(alerts(events_stream(spark, d)))


# -- T6: windowed counts behind a watermark --------------------------------------------------
def event_windows(events: DataFrame, beats: DataFrame, window: str = "1 day", delay: str = BACKFILL) -> DataFrame:
    """Counts of closed windows (append mode): a window is emitted once and its state freed."""
    rows = timed(event_view(events).select("ts", "severity"), beats, delay)
    return (rows.groupBy(F.window("event_time", window).alias("w"), "severity")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "severity", "n"))


@query("stream_event_windows", "T6", sql="""
SELECT date_trunc('day', ts) AS window_start, severity, count(*) AS n FROM v_event GROUP BY 1, 2""")
def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily tumbling counts by severity, each emitted when the watermark closes its day."""
    j = job(spark, "event-windows")
    return j.finish(event_windows(events_stream(spark, d), j.heartbeats()))


# -- T1: ticks chained in event-time order ------------------------------------------------------
def price_change_stream(events: DataFrame, beats: DataFrame, delay: str = BACKFILL, slot_ms: int = 24 * HOUR_MS) -> DataFrame:
    """Each tick's change against the one before it by (ts, id) of its price type."""
    ticks = tick_view(events).select("id", "ts", F.col("price_type").alias("key"), F.col("price").alias("value"))
    rows = timed(ticks, beats, delay).withColumn("us", micros("event_time"))
    out = in_event_order(rows, chained_changes, "last_price double", "double",
                         "us long, id long, price double, prev_price double, change_abs double, change_pct double", slot_ms)
    nan_as_null = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("prev_price", "change_abs", "change_pct")]
    return out.select("id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), F.col("key").alias("price_type"),
                      "price", *nan_as_null)


@query("stream_price_change", "T1", sql=f"""
SELECT id, ts, price_type, price, prev_price, {Q.round_fixed('price - prev_price', 2)} AS change_abs,
       {Q.round_fixed('(price - prev_price) / prev_price * 100', 2)} AS change_pct
FROM (SELECT *, lag(price) OVER (PARTITION BY price_type ORDER BY ts, id) AS prev_price FROM v_tick) t""")
def stream_price_change(spark: SparkSession, d: str) -> DataFrame:
    """Real-time tick changes; each tick chains onto the previous one of its type."""
    j = job(spark, "price-change")
    return j.finish(price_change_stream(events_stream(spark, d), j.heartbeats()))


# -- T4: debounce by session windows ------------------------------------------------------------
def _user_events(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("id"), "user_id", "ts", "value")


def debounced_stream(events: DataFrame, beats: DataFrame, wait_seconds: int = 300, delay: str = BACKFILL) -> DataFrame:
    """The last event of each burst: sessions end ``wait_seconds`` after their last event, exclusive."""
    rows = timed(_user_events(events), beats, delay)
    last = F.max_by(F.struct("id", "ts", "value"), F.struct("ts", "id"))
    # Sessions that touch are merged, so the gap is a microsecond short of the wait: an event exactly
    # ``wait_seconds`` after another begins a burst of its own.
    gap = f"{wait_seconds - 1} seconds 999999 microseconds"
    return (rows.groupBy(F.session_window("event_time", gap).alias("w"), "user_id").agg(last.alias("r"))
            .select("r.id", "user_id", "r.ts", "r.value"))


@query("stream_debounce", "T4", sql="""
SELECT id, user_id, ts, value FROM (
  SELECT event_id AS id, user_id, ts, value,
         lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nts FROM events) x
WHERE nts IS NULL OR epoch_us(nts) - epoch_us(ts) >= 300 * 1000000""")
def stream_debounce(spark: SparkSession, d: str) -> DataFrame:
    """Per user: the last event of each burst, when the watermark has closed the burst."""
    j = job(spark, "debounce")
    return j.finish(debounced_stream(events_stream(spark, d), j.heartbeats()))


# -- T5: throttle by ordered state ----------------------------------------------------------------
def throttled_stream(events: DataFrame, beats: DataFrame, limit_seconds: int = 3600, delay: str = BACKFILL,
                     slot_ms: int = 24 * HOUR_MS) -> DataFrame:
    """Events at least ``limit_seconds`` after the last one of their user that passed.

    A user's last pass is forgotten once the watermark is ``limit_seconds`` past it: whatever comes then passes.
    """
    rows = _user_events(events).select("id", "ts", F.col("user_id").alias("key"), "value")
    timed_rows = timed(rows, beats, delay).withColumn("us", micros("event_time"))
    out = in_event_order(timed_rows, throttled(limit_seconds * 1_000_000), "last_pass long", "double",
                         "us long, id long, value double", slot_ms, idle_ms=limit_seconds * 1000)
    return out.select("id", F.col("key").alias("user_id"), F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "value")
