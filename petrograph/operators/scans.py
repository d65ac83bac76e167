"""Scans, latest-row lookups and snapshot sources/sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrograph.operators.ordering import extreme_row
from petrograph.plans.registry import query
from petrograph.plans.snapshots import SnapshotStore
from petrograph.plans.storage import scratch_path
from petrograph.sources.views import trend_of, v_country, v_event, v_prediction, v_price


@query("scan_countries", "S1", sql="SELECT * FROM v_country")
def scan_countries(spark: SparkSession, d: str) -> DataFrame:
    return v_country(spark, d)


@query("scan_events", "S2", sql="""
SELECT id, ts, title, event_type, severity, sentiment, immediate, array_to_string(countries, ',') AS countries
FROM v_event""")
def scan_events(spark: SparkSession, d: str) -> DataFrame:
    return v_event(spark, d).withColumn("countries", F.concat_ws(",", "countries"))


@query("scan_prices", "S3", sql="SELECT * FROM v_price")
def scan_prices(spark: SparkSession, d: str) -> DataFrame:
    return v_price(spark, d)


def latest_by(df: DataFrame, keys: list[str], value_cols: list[str],
              order_cols: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """Latest row per key by (ts, id).

    Hash-aggregated with partial (map-side) aggregation (see
    ``ordering.extreme_row``): each task ships one candidate per key, so even
    a key holding a third of the rows costs one row per task in the shuffle.
    """
    best = extreme_row(df, keys, list(order_cols), value_cols, alias="_best")
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in value_cols])


@query("latest_prediction", "S4", sql="""
SELECT horizon, arg_max(id, (ts, id)) AS id, arg_max(ts, (ts, id)) AS ts, arg_max(price, (ts, id)) AS price,
       arg_max(confidence, (ts, id)) AS confidence, arg_max(trend, (ts, id)) AS trend
FROM v_prediction GROUP BY horizon""")
def latest_prediction(spark: SparkSession, d: str) -> DataFrame:
    """Latest prediction per time horizon.

    The trend text follows from the price, so it is derived from the few rows found and the
    aggregate keeps primitive values only: one scan, and one row per horizon and task shuffled.
    """
    p = latest_by(v_prediction(spark, d), ["horizon"], ["id", "ts", "price", "confidence"])
    return p.withColumn("trend", trend_of(F.col("price")))


def _counts(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n")
             for name, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)


_COUNTS_SQL = """
SELECT 'country' AS entity, count(*) AS n FROM v_country
UNION ALL SELECT 'event', count(*) FROM v_event
UNION ALL SELECT 'price', count(*) FROM v_price
UNION ALL SELECT 'prediction', count(*) FROM v_prediction"""


def _snapshot_frames(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"country": v_country(spark, d), "event": v_event(spark, d),
            "price": v_price(spark, d), "prediction": v_prediction(spark, d, nested=True)}


@query("snapshot_counts", "S5", sql=_COUNTS_SQL)
def snapshot_counts(spark: SparkSession, d: str) -> DataFrame:
    """The four entity loads in one plan; any read error fails the whole job."""
    return _counts(spark, _snapshot_frames(spark, d))


# Fact tables are written partitioned by time so date filters on the
# snapshot prune whole folders: events and predictions (weeks of data) by
# day, prices (years of orders) by month.  Dimensions (25 countries) are one
# folder.
PARTITION_COLUMN = {"event": ("day", "day"), "prediction": ("day", "day"), "price": ("month", "month")}
MAX_RECORDS_PER_FILE = 5_000_000


def write_snapshot(frames: dict[str, DataFrame], root: str) -> dict[str, str]:
    """Replace-whole-collection writes (``mode('overwrite')``), one folder each.

    Before a partitioned write the rows are range-partitioned on (partition
    column, id): each task then holds a contiguous slice of days and writes
    a few folders, instead of one file per (task, day) - on unclustered input
    that is tasks x days small files.  The sampled range bounds split a hot
    day across tasks, and ``maxRecordsPerFile`` caps file size.
    """
    paths = {}
    for name, df in frames.items():
        path = f"{root}/{name}"
        part = PARTITION_COLUMN.get(name)
        if part:
            col, unit = part
            df = (df.withColumn(col, F.trunc(F.col("ts").cast("date"), unit) if unit == "month"
                                else F.to_date("ts"))
                  .repartitionByRange(col, "id"))
        writer = df.write.mode("overwrite").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        if part:
            writer = writer.partitionBy(part[0])
        writer.parquet(path)
        paths[name] = path
    return paths


def snapshot_store(spark: SparkSession, root: str) -> SnapshotStore:
    """The entities' versioned snapshots below ``root``, cut by day or month as above."""
    parts = {name: (col, F.trunc(F.col("ts").cast("date"), unit) if unit == "month" else F.to_date("ts"))
             for name, (col, unit) in PARTITION_COLUMN.items()}
    return SnapshotStore(spark, root, parts, MAX_RECORDS_PER_FILE)


@query("snapshot_write", "S6", sql=_COUNTS_SQL)
def snapshot_write(spark: SparkSession, d: str) -> DataFrame:
    """Write the entity snapshot to the shared folder; the counts that its manifest gives."""
    store = snapshot_store(spark, scratch_path(spark, "snapshot"))
    store.write(_snapshot_frames(spark, d))
    return store.counts()
