"""The modelled application's sample records, as test input.

Fixed values: the literal countries, events, prices, prediction and
country-event edges of the modelled dashboard, in their natural order, with
only the fields the operators read.  Expected results are in FIXTURES.md §2.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTRIES = [
    # id, name, code, oilProduction
    ("usa", "United States", "US", 19500000.0),
    ("russia", "Russia", "RU", 11500000.0),
    ("saudi_arabia", "Saudi Arabia", "SA", 12300000.0),
    ("iran", "Iran", "IR", 3800000.0),
    ("china", "China", "CN", 4900000.0),
    ("canada", "Canada", "CA", 5500000.0),
]

EVENTS = [
    # id, title, timestamp, countries, severity, sentimentScore, impact.immediate
    ("event_1", "US Sanctions on Russian Oil Exports", "2024-01-15 14:30:00", ["usa", "russia"],
     "critical", -0.85, 0.95),
    ("event_2", "OPEC+ Production Cut Agreement", "2024-01-14 09:15:00", ["saudi_arabia", "russia"],
     "high", 0.65, 0.80),
    ("event_3", "Iran Nuclear Deal Negotiations Resume", "2024-01-13 16:45:00", ["iran", "usa"],
     "medium", 0.35, 0.40),
    ("event_4", "China Strategic Petroleum Reserve Purchases", "2024-01-12 11:20:00", ["china"],
     "medium", 0.25, 0.50),
]

PRICES = [
    # timestamp, price, priceType, change.percentage
    ("2024-01-15 15:00:00", 78.45, "WTI", 2.82),
    ("2024-01-15 14:00:00", 76.30, "WTI", -0.58),
    ("2024-01-15 13:00:00", 76.75, "WTI", 1.65),
]

PREDICTION = {
    "id": "pred_1", "timestamp": "2024-01-15 15:30:00", "price": 79.85, "confidence": 0.94,
    "timeHorizon": "24h", "trend": "bullish",
    "primaryFactors": [("OPEC+ Production Cut", 0.75, 0.92), ("US-Russia Sanctions", 0.65, 0.88),
                       ("China Demand Increase", 0.35, 0.76)],
    "keyEvents": ["event_1", "event_2"],
    "affectedCountries": ["usa", "russia", "saudi_arabia", "china"],
}

COUNTRY_EVENT_EDGES = [
    # source, target, weight, type
    ("usa", "event_1", 0.95, "causation"),
    ("russia", "event_1", 0.90, "correlation"),
    ("saudi_arabia", "event_2", 0.85, "causation"),
    ("russia", "event_2", 0.80, "correlation"),
    ("iran", "event_3", 0.75, "correlation"),
    ("china", "event_4", 0.70, "causation"),
]


def _ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def countries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COUNTRIES, "id string, name string, code string, oil_production double")


def events(spark: SparkSession) -> DataFrame:
    rows = [(i, t, _ts(ts), c, s, se, im) for i, t, ts, c, s, se, im in EVENTS]
    return spark.createDataFrame(rows, "id string, title string, ts timestamp_ntz, countries array<string>, "
                                       "severity string, sentiment double, immediate double")


def prices(spark: SparkSession) -> DataFrame:
    rows = [(k, _ts(ts), p, t) for k, (ts, p, t, _) in enumerate(PRICES)]
    return spark.createDataFrame(rows, "id long, ts timestamp_ntz, price double, price_type string")


def graph(spark: SparkSession):
    """(nodes, edges) built from the literals with the library's builders."""
    from petrograph.operators.graph import EDGE_COLS, country_nodes_of, event_nodes_of, nodes_of, price_node_of

    nodes = nodes_of(country_nodes_of(countries(spark)), event_nodes_of(events(spark)),
                     price_node_of(prices(spark)))
    ce = spark.createDataFrame(
        [(f"edge_{i}", f"c:{s}", f"e:{t}", w, ty) for i, (s, t, w, ty) in enumerate(COUNTRY_EVENT_EDGES)],
        "id string, source string, target string, weight double, type string")
    ep = events(spark).select(F.concat(F.lit("price_edge_"), "id").alias("id"),
                              F.concat(F.lit("e:"), "id").alias("source"), F.lit("p:current").alias("target"),
                              F.col("immediate").alias("weight"), F.lit("influence").alias("type"))
    return nodes, ce.select(*EDGE_COLS).unionByName(ep.select(*EDGE_COLS))
