"""Derived display columns and nested-field work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrograph.functions import exprs as X
from petrograph.functions import sqltext as Q
from petrograph.operators.graph import graph_edges_df, graph_nodes_df
from petrograph.operators.scans import latest_prediction
from petrograph.plans.registry import query
from petrograph.sources.views import country_dim, v_event, v_prediction


def trend_colour(t) -> F.Column:
    t = F.col(t) if isinstance(t, str) else t
    return F.when(t == "bullish", "green").when(t == "bearish", "red").otherwise("yellow")


@query("prediction_card", "D4", sql=f"""
SELECT horizon, id, '$' || {Q.to_fixed('price', 2)} AS price_text, trend,
       CASE trend WHEN 'bullish' THEN 'green' WHEN 'bearish' THEN 'red' ELSE 'yellow' END AS trend_colour,
       {Q.pct_text('confidence', 1)} AS confidence_text
FROM (SELECT horizon, arg_max(id, (ts, id)) AS id, arg_max(price, (ts, id)) AS price,
             arg_max(trend, (ts, id)) AS trend, arg_max(confidence, (ts, id)) AS confidence
      FROM v_prediction GROUP BY horizon) x""")
def prediction_card(spark: SparkSession, d: str) -> DataFrame:
    """Latest prediction card per horizon (the true horizon, not a fixed '24h')."""
    p = latest_prediction(spark, d)
    return p.select("horizon", "id", F.concat(F.lit("$"), X.to_fixed("price", 2)).alias("price_text"),
                    "trend", trend_colour("trend").alias("trend_colour"),
                    X.pct_text("confidence", 1).alias("confidence_text"))


@query("node_detail", "D6", sql=f"""
SELECT id, type, label,
       CASE type WHEN 'country' THEN 'Code: ' || code || '; Oil Production: ' ||
                                     {Q.to_fixed('oil_production / 1000000.0', 1)} || 'M bbl/day'
                 WHEN 'event' THEN 'Severity: ' || severity || '; Impact: ' || {Q.pct_text('immediate', 0)}
                 ELSE 'Price: ' || {Q.to_fixed('price', 2)} END AS detail
FROM g_nodes""")
def node_detail(spark: SparkSession, d: str) -> DataFrame:
    """Per node type: country code and production (M bbl/day, 1 dp); event
    severity and impact (%, 0 dp); price node price (2 dp)."""
    n = graph_nodes_df(spark, d)
    t = F.col("type")
    detail = (F.when(t == "country", F.concat(F.lit("Code: "), "code", F.lit("; Oil Production: "),
                                              X.to_fixed(F.col("oil_production") / 1e6, 1), F.lit("M bbl/day")))
              .when(t == "event", F.concat(F.lit("Severity: "), "severity", F.lit("; Impact: "),
                                           X.pct_text("immediate", 0)))
              .otherwise(F.concat(F.lit("Price: "), X.to_fixed("price", 2))))
    return n.select("id", "type", "label", detail.alias("detail"))


@query("edge_detail", "D7", sql=f"""
SELECT id, type, {Q.pct_text('weight', 0)} AS strength, source, target FROM g_edges""")
def edge_detail(spark: SparkSession, d: str) -> DataFrame:
    return graph_edges_df(spark, d).select("id", "type", X.pct_text("weight", 0).alias("strength"),
                                           "source", "target")


@query("defaulted_metrics", "D9", sql=f"""
SELECT id, {Q.or_zero('immediate')} AS immediate, {Q.or_zero('sentiment')} AS sentiment FROM v_event""")
def defaulted_metrics(spark: SparkSession, d: str) -> DataFrame:
    """``x?.a?.b || 0``: missing, null, NaN and 0 all read as 0."""
    return v_event(spark, d).select("id", X.or_zero("immediate").alias("immediate"),
                                    X.or_zero("sentiment").alias("sentiment"))


@query("prediction_top_factors", "K2", sql=f"""
SELECT id, pos, f.factor AS factor, {Q.pct_text('f.impact', 0)} AS impact_pct
FROM (SELECT id, unnest(list_slice(primary_factors, 1, 3)) AS f,
             generate_subscripts(list_slice(primary_factors, 1, 3), 1) - 1 AS pos FROM v_prediction) x""")
def prediction_top_factors(spark: SparkSession, d: str) -> DataFrame:
    """First three primary factors in stored order, impact as a 0 dp percent."""
    p = v_prediction(spark, d, nested=True).select(
        "id", F.posexplode(F.slice("primary_factors", 1, 3)).alias("pos", "f"))
    return p.select("id", F.col("pos").cast("long").alias("pos"), F.col("f.factor").alias("factor"),
                    X.pct_text("f.impact", 0).alias("impact_pct"))


@query("prediction_key_events", "J5", sql="""
SELECT x.id, x.pos, x.event_id, e.id IS NOT NULL AS found, e.title
FROM (SELECT id, unnest(key_events) AS event_id, generate_subscripts(key_events, 1) - 1 AS pos
      FROM v_prediction) x
LEFT JOIN v_event e ON CAST(e.id AS VARCHAR) = x.event_id""")
def prediction_key_events(spark: SparkSession, d: str) -> DataFrame:
    """``explanation.keyEvents[] -> event.id``: a shuffle equi-join on the id."""
    p = v_prediction(spark, d, nested=True).select(
        "id", F.posexplode("key_events").alias("pos", "event_id"))
    ev = v_event(spark, d).select(F.col("id").cast("string").alias("_eid"), "title")
    return (p.join(ev, p.event_id == ev._eid, "left")
            .select("id", F.col("pos").cast("long").alias("pos"), "event_id",
                    F.col("_eid").isNotNull().alias("found"), "title"))


@query("prediction_countries", "J6", sql="""
SELECT x.id, x.pos, x.country_id, c.id IS NOT NULL AS found, c.code
FROM (SELECT id, unnest(affected_countries) AS country_id, generate_subscripts(affected_countries, 1) - 1 AS pos
      FROM v_prediction) x
LEFT JOIN v_country c ON c.id = x.country_id""")
def prediction_countries(spark: SparkSession, d: str) -> DataFrame:
    """``explanation.affectedCountries[] -> country.id`` (broadcast dimension)."""
    p = v_prediction(spark, d, nested=True).select(
        "id", F.posexplode("affected_countries").alias("pos", "country_id"))
    dim = F.broadcast(country_dim(spark, d).select(F.col("id").alias("_cid"), "code"))
    return (p.join(dim, p.country_id == dim._cid, "left")
            .select("id", F.col("pos").cast("long").alias("pos"), "country_id",
                    F.col("_cid").isNotNull().alias("found"), "code"))
