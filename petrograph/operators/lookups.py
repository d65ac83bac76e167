"""Filters and lookups.

Point lookups of the modelled service are re-aimed as bulk lookups: a table
of requested ids joined to the entity table, so one job answers any number
of requests.  Filters are plain predicates that Catalyst pushes into the
parquet scan where the column is a raw one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from petrograph.functions.exprs import ts_ntz
from petrograph.plans.registry import query
from petrograph.sources.tables import read_table
from petrograph.sources.views import country_dim, v_country, v_event, v_prediction, v_price


# -- generic building blocks ----------------------------------------------------
def match_all(filters: dict) -> Column:
    """AND of null-safe equalities; an empty filter keeps every row.

    A dict value stands for a struct column and is compared field by field (fields not named match
    anything; of a NULL struct, every field is NULL).
    """
    def same(c: Column, v) -> Column:
        if isinstance(v, dict):
            return reduce(lambda a, b: a & b, [same(c.getField(f), x) for f, x in v.items()], F.lit(True))
        return c.eqNullSafe(F.lit(v))

    return reduce(lambda a, b: a & b, [same(F.col(k), v) for k, v in filters.items()], F.lit(True))


def in_range(col: str, lo: str, hi: str) -> Column:
    """Both ends inclusive, on zone-less timestamps."""
    return (F.col(col) >= ts_ntz(lo)) & (F.col(col) <= ts_ntz(hi))


def has_member(arr: str, value: str) -> Column:
    """``array.includes``: always a boolean (NULL elements never match)."""
    return F.coalesce(F.array_contains(F.col(arr), F.lit(value)), F.lit(False))


def country_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requested country ids: NATION_(user_id % 30); 25..29 do not exist."""
    return read_table(spark, d, "events", "event_id", "user_id").select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("NATION_"), (F.col("user_id") % 30).cast("string")).alias("id"))


_REQ_SQL = "SELECT event_id AS request_id, 'NATION_' || CAST(user_id % 30 AS VARCHAR) AS id FROM events"


# -- queries ----------------------------------------------------------------------
@query("country_by_id", "F1", sql=f"""
SELECT r.request_id, r.id, c.id IS NOT NULL AS found, c.name, c.code
FROM ({_REQ_SQL}) r LEFT JOIN v_country c ON r.id = c.id""")
def country_by_id(spark: SparkSession, d: str) -> DataFrame:
    dim = F.broadcast(country_dim(spark, d).select(F.col("id").alias("cid"), "name", "code"))
    return (country_requests(spark, d).join(dim, F.col("id") == F.col("cid"), "left")
            .select("request_id", "id", F.col("cid").isNotNull().alias("found"), "name", "code"))


@query("country_ids_missing", "F2", sql=f"""
SELECT r.request_id, r.id FROM ({_REQ_SQL}) r WHERE NOT EXISTS (SELECT 1 FROM v_country c WHERE c.id = r.id)""")
def country_ids_missing(spark: SparkSession, d: str) -> DataFrame:
    return country_requests(spark, d).join(F.broadcast(country_dim(spark, d).select("id")), "id", "left_anti")


@query("country_by_filter", "F3", sql="SELECT * FROM v_country WHERE region = 'ASIA'")
def country_by_filter(spark: SparkSession, d: str, filters: dict | None = None) -> DataFrame:
    return v_country(spark, d).where(match_all({"region": "ASIA"} if filters is None else filters))


@query("events_by_date_range", "F4", sql="""
SELECT id, ts, title, severity FROM v_event
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'""")
def events_by_date_range(spark: SparkSession, d: str,
                         lo: str = "2024-01-05 00:00:00", hi: str = "2024-01-20 00:00:00") -> DataFrame:
    return v_event(spark, d).where(in_range("ts", lo, hi)).select("id", "ts", "title", "severity")


@query("events_by_country", "F5", sql="""
SELECT id, ts, title FROM v_event WHERE coalesce(list_contains(countries, 'NATION_3'), false)""")
def events_by_country(spark: SparkSession, d: str, country: str = "NATION_3") -> DataFrame:
    return v_event(spark, d).where(has_member("countries", country)).select("id", "ts", "title")


@query("events_by_severity", "F6", sql="SELECT id, ts, title, severity FROM v_event WHERE severity = 'high'")
def events_by_severity(spark: SparkSession, d: str, severity: str = "high") -> DataFrame:
    return v_event(spark, d).where(F.col("severity") == severity).select("id", "ts", "title", "severity")


def prices_between(spark: SparkSession, d: str, lo: str, hi: str, price_type: str | None) -> DataFrame:
    df = v_price(spark, d).where(in_range("ts", lo, hi))
    if price_type:
        df = df.where(F.col("price_type") == price_type)
    return df


@query("prices_historical", "F7", sql="""
SELECT * FROM v_price WHERE ts >= TIMESTAMP '1997-01-01' AND ts <= TIMESTAMP '1998-12-31' AND price_type = 'Brent'""")
def prices_historical(spark: SparkSession, d: str) -> DataFrame:
    return prices_between(spark, d, "1997-01-01 00:00:00", "1998-12-31 00:00:00", "Brent")


@query("prices_historical_all_types", "F7", sql="""
SELECT * FROM v_price WHERE ts >= TIMESTAMP '1997-01-01' AND ts <= TIMESTAMP '1998-12-31'""")
def prices_historical_all_types(spark: SparkSession, d: str) -> DataFrame:
    return prices_between(spark, d, "1997-01-01 00:00:00", "1998-12-31 00:00:00", None)


@query("prediction_explanation", "F8", sql="""
SELECT id, CAST(len(primary_factors) AS BIGINT) AS n_factors,
       array_to_string(list_transform(primary_factors, lambda x: x.factor), ',') AS factors,
       array_to_string(key_events, ',') AS key_events,
       array_to_string(affected_countries, ',') AS affected_countries
FROM v_prediction""")
def prediction_explanation(spark: SparkSession, d: str) -> DataFrame:
    p = v_prediction(spark, d, nested=True)
    return p.select("id", F.size("primary_factors").cast("long").alias("n_factors"),
                    F.concat_ws(",", F.transform("primary_factors", lambda x: x["factor"])).alias("factors"),
                    F.concat_ws(",", "key_events").alias("key_events"),
                    F.concat_ws(",", "affected_countries").alias("affected_countries"))


@query("predictions_by_horizon", "F9", sql="""
SELECT id, ts, horizon, price, confidence, trend FROM v_prediction WHERE horizon = '24h'""")
def predictions_by_horizon(spark: SparkSession, d: str, horizon: str = "24h") -> DataFrame:
    return (v_prediction(spark, d).where(F.col("horizon") == horizon)
            .select("id", "ts", "horizon", "price", "confidence", "trend"))


def entity_requests(spark: SparkSession, d: str) -> DataFrame:
    """(request_id, kind, key): one country, one event, one prediction per events row,
    generated from a single scan."""
    e = read_table(spark, d, "events", "event_id", "user_id")
    reqs = F.array(
        F.struct(F.lit("country").alias("kind"),
                 F.concat(F.lit("NATION_"), (F.col("user_id") % 30).cast("string")).alias("key")),
        F.struct(F.lit("event").alias("kind"), (F.col("user_id") * 67).cast("string").alias("key")),
        F.struct(F.lit("prediction").alias("kind"), F.col("event_id").cast("string").alias("key")))
    return e.select(F.col("event_id").alias("request_id"), F.inline(reqs))


def entity_targets(spark: SparkSession, d: str) -> DataFrame:
    """(kind, key, label) for every country, event and prediction."""
    return (country_dim(spark, d).select(F.lit("country").alias("kind"), F.col("id").alias("key"),
                                         F.col("name").alias("label"))
            .unionByName(v_event(spark, d).select(F.lit("event").alias("kind"),
                                                  F.col("id").cast("string").alias("key"),
                                                  F.col("title").alias("label")))
            .unionByName(v_prediction(spark, d).select(F.lit("prediction").alias("kind"),
                                                       F.col("id").cast("string").alias("key"),
                                                       F.col("horizon").alias("label"))))


@query("entity_lookup", "F10", sql="""
WITH r AS (
  SELECT event_id AS request_id, 'country' AS kind, 'NATION_' || CAST(user_id % 30 AS VARCHAR) AS key FROM events
  UNION ALL SELECT event_id, 'event', CAST(user_id * 67 AS VARCHAR) FROM events
  UNION ALL SELECT event_id, 'prediction', CAST(event_id AS VARCHAR) FROM events)
SELECT r.request_id, r.kind, r.key, c.id IS NOT NULL AS found, c.name AS label
FROM r LEFT JOIN v_country c ON r.kind = 'country' AND r.key = c.id WHERE r.kind = 'country'
UNION ALL
SELECT r.request_id, r.kind, r.key, e.id IS NOT NULL, e.title
FROM r LEFT JOIN v_event e ON r.kind = 'event' AND r.key = CAST(e.id AS VARCHAR) WHERE r.kind = 'event'
UNION ALL
SELECT r.request_id, r.kind, r.key, p.id IS NOT NULL, p.horizon
FROM r LEFT JOIN v_prediction p ON r.kind = 'prediction' AND r.key = CAST(p.id AS VARCHAR) WHERE r.kind = 'prediction'
""")
def entity_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Store-style getters by id for three kinds; absent ids give found=false.

    One scan generates all requests.  Countries, which few keys may ask for many times, are answered by
    a broadcast of the 25-row dimension; events and predictions by an equi-join on (kind, key), where
    country requests carry a key of their own (ids are unique per kind, so no request is multiplied).
    """
    t = entity_targets(spark, d)
    few = t.where("kind = 'country'").select(F.col("kind").alias("_fkind"), F.col("key").alias("_fkey"),
                                             F.col("label").alias("_flabel"))
    many = t.where("kind <> 'country'").select(F.col("kind").alias("_tkind"), F.col("key").alias("_tkey"),
                                               F.col("label").alias("_tlabel"))
    req = entity_requests(spark, d)
    own = F.when(F.col("kind") == "country", F.concat(F.lit("~"), F.col("request_id").cast("string"))) \
        .otherwise(F.col("key"))
    j = (req.join(F.broadcast(few), (req.kind == few._fkind) & (req.key == few._fkey), "left")
         .join(many, (F.col("kind") == F.col("_tkind")) & (own == F.col("_tkey")), "left"))
    return j.select("request_id", "kind", "key", F.coalesce("_fkey", "_tkey").isNotNull().alias("found"),
                    F.coalesce("_flabel", "_tlabel").alias("label"))


@query("search_entities", "F11", sql="""
SELECT * FROM (
  SELECT 'event' AS kind, CAST(id AS VARCHAR) AS id, title AS text FROM v_event
  UNION ALL SELECT 'country', id, name FROM v_country
  UNION ALL SELECT 'prediction', CAST(id AS VARCHAR), horizon || ' ' || trend FROM v_prediction) s
WHERE contains(lower(text), lower('ERROR'))""")
def search_entities(spark: SparkSession, d: str, q: str = "ERROR") -> DataFrame:
    """Case-insensitive literal substring search over event titles, country names and the horizon and
    trend of predictions (as in "24h up").  One search scans; many go through ``search.TrigramIndex``."""
    return entity_texts(spark, d).where(F.lower("text").contains(q.lower()))


def entity_texts(spark: SparkSession, d: str) -> DataFrame:
    """(kind, id, text) of everything that can be searched."""
    return (v_event(spark, d).select(F.lit("event").alias("kind"), F.col("id").cast("string").alias("id"),
                                     F.col("title").alias("text"))
            .unionByName(country_dim(spark, d).select(F.lit("country").alias("kind"), "id",
                                                      F.col("name").alias("text")))
            .unionByName(v_prediction(spark, d).select(F.lit("prediction").alias("kind"),
                                                       F.col("id").cast("string").alias("id"),
                                                       F.concat("horizon", F.lit(" "), "trend").alias("text"))))
