"""SparkSession construction with the settings every job here relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings every query assumes.  Time semantics follow UTC (timestamps in the
# data are zone-less); AQE re-plans joins and coalesces partitions at run time
# and splits skewed sort-merge join partitions.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "petrograph",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with ``BASE_CONF`` applied.

    On a cluster ``master`` stays None and the launcher decides; tests pass
    ``local[N]``.  ``shuffle_partitions`` should be sized to the data: on a
    100 TB input that is several thousand (~128-256 MB per post-shuffle
    partition); AQE coalesces it down for small stages.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", os.environ.get("PETROGRAPH_DRIVER_MEM", "8g"))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # Session-level settings also apply to a session that already existed.
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled",
              "spark.sql.adaptive.skewJoin.enabled"):
        spark.conf.set(k, conf[k])
    return spark


def ensure_utc(spark: SparkSession) -> None:
    """Queries compare zone-less timestamps against literals; pin UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
