"""KPIs and rollups.

One-row KPIs are combined by ``unionByName`` + a final global aggregate
instead of cross-joining one-row frames; every grouped aggregate runs with
partial (map-side) aggregation, and distinct counts expand to a two-level
aggregate on (group, value) so no group's values gather in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from petrograph.functions import exprs as X
from petrograph.functions import sqltext as Q
from petrograph.operators.ordering import extreme_row
from petrograph.operators.sequences import current_price
from petrograph.plans.registry import query
from petrograph.sources.views import country_dim, v_event, v_prediction


def combine_one_row(*frames: DataFrame) -> DataFrame:
    """Merge one-row frames with disjoint columns into one row (no cross join)."""
    cols = [c for f in frames for c in f.columns]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return u.agg(*[F.max(c).alias(c) for c in cols])


@query("dashboard_kpis", "A1", sql=f"""
WITH cp AS (
  SELECT price_type, ts, id, price, change_pct FROM (
    SELECT *, {Q.round_fixed('(price - lag(price) OVER w) / lag(price) OVER w * 100', 2)} AS change_pct
    FROM v_price WINDOW w AS (PARTITION BY price_type ORDER BY ts, id)) x)
SELECT {Q.or_zero('(SELECT arg_max(price, (ts, id)) FROM cp)')} AS current_price,
       {Q.or_zero('(SELECT arg_max(change_pct, (ts, id)) FROM cp)')} AS change_pct,
       (SELECT count(*) FROM v_event WHERE severity = 'critical') AS critical_events,
       (SELECT count(*) FROM v_country) AS active_countries,
       {Q.or_zero('(SELECT arg_max(confidence, (ts, id)) FROM v_prediction)')} AS model_confidence""")
def dashboard_kpis(spark: SparkSession, d: str) -> DataFrame:
    """Current price and its change, critical events, countries, latest confidence."""
    return kpis_of(current_price(spark, d), v_event(spark, d), country_dim(spark, d), v_prediction(spark, d))


def kpis_of(current: DataFrame, events: DataFrame, countries: DataFrame, predictions: DataFrame) -> DataFrame:
    """``current``: latest price per type with ``change_pct`` (see ``current_price``)."""
    latest = extreme_row(current, [], ["ts", "id"], ["price", "change_pct"], alias="_p").select(
        X.or_zero("_p.price").alias("current_price"), X.or_zero("_p.change_pct").alias("change_pct"))
    critical = events.agg(F.count_if(F.col("severity") == "critical").alias("critical_events"))
    n_countries = countries.agg(F.count(F.lit(1)).alias("active_countries"))
    conf = extreme_row(predictions, [], ["ts", "id"], ["confidence"], alias="_c").select(
        X.or_zero("_c.confidence").alias("model_confidence"))
    return combine_one_row(latest, critical, n_countries, conf)


def _daily(spark: SparkSession, d: str) -> DataFrame:
    ev = v_event(spark, d).select(F.to_date("ts").alias("day"), "countries")
    countries = (ev.select("day", F.explode("countries").alias("c"))
                 .groupBy("day").agg(F.countDistinct("c").alias("active_countries")))
    events = ev.groupBy("day").agg(F.count(F.lit(1)).alias("live_events"))
    conf = (v_prediction(spark, d).groupBy(F.to_date("ts").alias("day"))
            .agg(F.avg("confidence").alias("_conf")))
    return (countries.join(events, "day", "full").join(conf, "day", "full")
            .select("day", F.coalesce("active_countries", F.lit(0)).cast("long").alias("active_countries"),
                    F.coalesce("live_events", F.lit(0)).cast("long").alias("live_events"),
                    X.round_fixed("_conf", 9).alias("avg_confidence")))


@query("metric_delta", "A5", sql=f"""
WITH ev AS (SELECT CAST(ts AS DATE) AS day, countries FROM v_event),
c AS (SELECT day, count(DISTINCT c) AS active_countries FROM (SELECT day, unnest(countries) AS c FROM ev) x GROUP BY day),
e AS (SELECT day, count(*) AS live_events FROM ev GROUP BY day),
p AS (SELECT CAST(ts AS DATE) AS day, avg(confidence) AS conf FROM v_prediction GROUP BY 1),
daily AS (
  SELECT coalesce(c.day, e.day, p.day) AS day, CAST(coalesce(active_countries, 0) AS BIGINT) AS active_countries,
         CAST(coalesce(live_events, 0) AS BIGINT) AS live_events, {Q.round_fixed('conf', 9)} AS avg_confidence
  FROM c FULL JOIN e ON c.day = e.day FULL JOIN p ON coalesce(c.day, e.day) = p.day)
SELECT CAST(d.day AS TIMESTAMP) AS day, d.active_countries, d.live_events, d.avg_confidence,
       d.active_countries - y.active_countries AS d_countries, d.live_events - y.live_events AS d_events,
       {Q.round_fixed('d.avg_confidence - y.avg_confidence', 9)} AS d_confidence,
       CASE WHEN d.live_events - y.live_events >= 0 THEN '+' ELSE '' END
         || CAST(d.live_events - y.live_events AS VARCHAR) AS events_change
FROM daily d LEFT JOIN daily y ON y.day = d.day - INTERVAL 1 DAY""")
def metric_delta(spark: SparkSession, d: str) -> DataFrame:
    """Per day: distinct countries, events, mean confidence, and the change vs.
    the previous calendar day (NULL when that day has no row).

    The shift runs as a window over the daily aggregate - one row per day, so
    a window without PARTITION BY is cheap there - instead of a self-join,
    which would compute the daily aggregate (and scan events) twice.
    """
    daily = _daily(spark, d)
    w = Window.orderBy("day")
    prev_ok = F.datediff(F.col("day"), F.lag("day").over(w)) == 1

    def prev(c: str) -> Column:
        return F.when(prev_ok, F.lag(c).over(w))

    de = F.col("live_events") - F.col("_ye")
    return (daily.select("*", prev("active_countries").alias("_yc"), prev("live_events").alias("_ye"),
                         prev("avg_confidence").alias("_yconf"))
            .select(F.col("day").cast("timestamp_ntz").alias("day"), "active_countries", "live_events",
                    "avg_confidence", (F.col("active_countries") - F.col("_yc")).alias("d_countries"),
                    de.alias("d_events"),
                    X.round_fixed(F.col("avg_confidence") - F.col("_yconf"), 9).alias("d_confidence"),
                    F.concat(F.when(de >= 0, "+").otherwise(""), de.cast("string")).alias("events_change")))


@query("country_coverage", "A6", sql="""
SELECT date_trunc('hour', ts) AS hour, count(DISTINCT c) AS n_countries, count(*) AS n_mentions
FROM (SELECT ts, unnest(countries) AS c FROM v_event) x GROUP BY 1""")
def country_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per hour: distinct countries mentioned by events."""
    ev = v_event(spark, d).select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
                                  F.explode("countries").alias("c"))
    return ev.groupBy("hour").agg(F.countDistinct("c").alias("n_countries"),
                                  F.count(F.lit(1)).alias("n_mentions"))


@query("feature_importance_rollup", "A7", sql=f"""
SELECT model_version, feature, count(*) AS n, {Q.round_fixed('avg(importance)', 9)} AS avg_importance
FROM (SELECT model_version, unnest(map_keys(feature_importance)) AS feature,
             unnest(map_values(feature_importance)) AS importance FROM v_prediction) x
GROUP BY model_version, feature""")
def feature_importance_rollup(spark: SparkSession, d: str) -> DataFrame:
    p = v_prediction(spark, d, nested=True).select(
        "model_version", F.explode("feature_importance").alias("feature", "importance"))
    return p.groupBy("model_version", "feature").agg(
        F.count(F.lit(1)).alias("n"), X.round_fixed(F.avg("importance"), 9).alias("avg_importance"))
