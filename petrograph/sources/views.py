"""The domain model (countries, events, prices, ticks, predictions, edges)
derived from the driver tables.

Every view is a lazy DataFrame over a pruned parquet scan, so its size grows
with the input and Catalyst can push filters placed on top of it down to the
scan.  The DuckDB twins live in ``petrograph.plans.oracle_views``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrograph.functions.exprs import round_fixed
from petrograph.sources.tables import read_table


def _nation_id(x):
    return F.concat(F.lit("NATION_"), x.cast("string"))


def v_country(spark: SparkSession, d: str) -> DataFrame:
    """25 nations with region, 'oil production' and 'reserves'.

    Production is total lineitem quantity shipped by the nation's suppliers.
    lineitem is pre-aggregated per supplier *before* the supplier join, so the
    only shuffle of the big table carries one partial sum per (task, supplier).
    """
    nation = read_table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, d, "region", "r_regionkey", "r_name")
    per_supp = (read_table(spark, d, "lineitem", "l_suppkey", "l_quantity")
                .groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q")))
    supplier = read_table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    prod = (per_supp.join(supplier, per_supp.l_suppkey == supplier.s_suppkey)
            .groupBy("s_nationkey").agg(F.sum("q").alias("oil_production")))
    bal = (read_table(spark, d, "customer", "c_nationkey", "c_acctbal")
           .groupBy("c_nationkey").agg(round_fixed(F.sum("c_acctbal"), 2).alias("oil_reserves")))
    # nation/region are fixed-size dimensions (25 / 5 rows): broadcast is safe.
    return (nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
            .join(prod, nation.n_nationkey == prod.s_nationkey, "left")
            .join(bal, nation.n_nationkey == bal.c_nationkey, "left")
            .select(F.col("n_name").alias("id"), F.col("n_name").alias("name"),
                    F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("code"),
                    F.col("r_name").alias("region"), "oil_production", "oil_reserves"))


def country_dim(spark: SparkSession, d: str) -> DataFrame:
    """id / name / code / region only: the nation x region dimension (25 rows).

    Lookups that only need codes use this instead of ``v_country`` so they
    never trigger the lineitem aggregation behind production figures.
    """
    nation = read_table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, d, "region", "r_regionkey", "r_name")
    return (nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
            .select(F.col("n_name").alias("id"), F.col("n_name").alias("name"),
                    F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("code"),
                    F.col("r_name").alias("region")))


def event_countries(event_id, user_id):
    """1 to 3 country ids per event; the third may be unknown (NATION_25/26)."""
    arr = F.array(_nation_id(user_id % 25), _nation_id((user_id + 5) % 25),
                  _nation_id((user_id + 12) % 27))
    return F.slice(arr, F.lit(1), (1 + event_id % 3).cast("int"))


def v_event(spark: SparkSession, d: str) -> DataFrame:
    return event_view(read_table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value"))


def event_view(e: DataFrame) -> DataFrame:
    """Events table (batch or streaming) -> geopolitical-event rows."""
    return e.select(*event_columns())


def event_columns() -> list:
    """The event's columns over a row of the events table."""
    et, v = F.col("event_type"), F.col("value")
    return [
        F.col("event_id").alias("id"),
        "ts",
        F.concat(et, F.lit(" event #"), F.col("event_id").cast("string")).alias("title"),
        (F.when(et == "error", "conflict").when(et == "click", "trade")
         .when(et == "view", "political").when(et == "signup", "economic")
         .otherwise("sanction")).alias("event_type"),
        (F.when(v >= 200, "critical").when(v >= 100, "high").when(v >= 40, "medium")
         .otherwise("low")).alias("severity"),
        (F.lit(1.0) - 2 * v / 500).alias("sentiment"),
        F.when(et == "view", F.lit(None).cast("double")).otherwise(v / 500).alias("immediate"),
        event_countries(F.col("event_id"), F.col("user_id")).alias("countries"),
    ]


def price_type_of_priority(p):
    return (F.when(p.isin("1-URGENT", "2-HIGH"), "WTI").when(p == "3-MEDIUM", "Brent")
            .otherwise("Dubai"))


def v_price(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"),
                    (F.col("o_totalprice") / 5000).alias("price"),
                    price_type_of_priority(F.col("o_orderpriority")).alias("price_type"))


def v_tick(spark: SparkSession, d: str) -> DataFrame:
    """Price ticks that overlap the event period (signup events)."""
    return tick_view(read_table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value"))


def tick_view(e: DataFrame) -> DataFrame:
    """Events table (batch or streaming) -> price ticks."""
    return e.where(is_tick()).select(*tick_columns())


def is_tick():
    return F.col("event_type") == "signup"


def tick_columns() -> list:
    u = F.col("user_id") % 3
    return [F.col("event_id").alias("id"), F.col("ts"), (50 + F.col("value") / 10).alias("price"),
            F.when(u == 0, "WTI").when(u == 1, "Brent").otherwise("Dubai").alias("price_type")]


def _horizon(event_id):
    r = event_id % 4
    return F.when(r == 0, "1h").when(r == 1, "6h").when(r == 2, "24h").otherwise("7d")


def trend_of(v):
    """Trend of a prediction by its value."""
    return F.when(v >= 100, "bullish").when(v < 20, "bearish").otherwise("neutral")


def v_prediction(spark: SparkSession, d: str, nested: bool = False) -> DataFrame:
    e = read_table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    return e.where(is_prediction()).select(*prediction_columns(nested))


def is_prediction():
    return F.col("event_type") == "purchase"


def prediction_columns(nested: bool) -> list:
    """The prediction's columns over a row of the events table."""
    v, k = F.col("value"), F.get_json_object("props", "$.k").cast("int")
    cols = [F.col("event_id").alias("id"), F.col("ts"), _horizon(F.col("event_id")).alias("horizon"),
            v.alias("price"), (v / 500).alias("confidence"),
            trend_of(v).alias("trend"),
            k.alias("k")]
    return [*cols, *prediction_nested_cols(F.col("event_id"), F.col("user_id"), k)] if nested else cols


def prediction_nested_cols(event_id, user_id, k):
    """The PredictionResult explanation / metadata parts (our definitions)."""
    factors = F.array(*[
        F.struct(F.lit(f"f{i}").alias("factor"),
                 ((k * (i + 3)) % 100 / F.lit(100.0)).alias("impact"),
                 ((k + 7 * i) % 100 / F.lit(100.0)).alias("confidence"))
        for i in range(4)])
    importance = F.create_map(F.lit("geopolitical_events"), k / F.lit(100.0),
                              F.lit("production_data"), 1 - k / F.lit(100.0))
    key_events = F.array((event_id - 1).cast("string"), (event_id + 1).cast("string"))
    return [factors.alias("primary_factors"), key_events.alias("key_events"),
            event_countries(event_id, user_id).alias("affected_countries"),
            F.concat(F.lit("v"), (k % 3).cast("string")).alias("model_version"),
            importance.alias("feature_importance")]


def v_country_event_edge(spark: SparkSession, d: str) -> DataFrame:
    """Membership edges country -> event (duplicates kept, weight 0 occurs)."""
    ev = v_event(spark, d).select("id", F.posexplode("countries").alias("pos", "country"))
    return ev.select(*country_edge_columns(F.col("id"), F.col("pos"), F.col("country")))


def country_edge_columns(event_id, pos, country) -> list:
    return [F.concat(F.lit("ce:"), event_id.cast("string"), F.lit(":"), pos.cast("string")).alias("id"),
            F.concat(F.lit("c:"), country).alias("source"),
            F.concat(F.lit("e:"), event_id.cast("string")).alias("target"),
            (event_id % 101 / F.lit(100.0)).alias("weight"),
            F.when(event_id % 2 == 0, "causation").otherwise("correlation").alias("type")]


def v_event_price_edge(spark: SparkSession, d: str) -> DataFrame:
    """event -> the single current-price node; weight = immediate impact."""
    ev = v_event(spark, d).where(F.col("immediate").isNotNull())
    return ev.select(*price_edge_columns(F.col("id"), F.col("immediate")))


def price_edge_columns(event_id, immediate) -> list:
    return [F.concat(F.lit("pe:"), event_id.cast("string")).alias("id"),
            F.concat(F.lit("e:"), event_id.cast("string")).alias("source"),
            F.lit("p:current").alias("target"),
            immediate.alias("weight"),
            F.lit("influence").alias("type")]
