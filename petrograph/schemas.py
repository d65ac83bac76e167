"""Entity schemas and enum domains of the oil-market data model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Enum domains and thresholds that must equal the modelled
# application's, stated in their natural order.
# ---------------------------------------------------------------------------
EVENT_TYPES = ("sanction", "conflict", "trade", "political", "economic", "natural_disaster")
SEVERITIES = ("low", "medium", "high", "critical")
PRICE_TYPES = ("WTI", "Brent", "Dubai")
NODE_TYPES = ("country", "event", "price_point")
EDGE_TYPES = ("correlation", "causation", "influence")
HORIZONS = ("1h", "6h", "24h", "7d")
TRENDS = ("bullish", "bearish", "neutral")
# Severity chip colours, impact bar colours and edge strength cut-offs.
SEVERITY_COLOURS = (("critical", "red"), ("high", "orange"), ("medium", "yellow"))
SEVERITY_DEFAULT_COLOUR = "gray"
IMPACT_RED_ABOVE = 0.7
IMPACT_YELLOW_ABOVE = 0.4
STRONG_ABOVE = 0.8
MEDIUM_ABOVE = 0.6
EVENT_NODE_COLOURS = (("critical", "#ef4444"), ("high", "#f59e0b"))
EVENT_NODE_DEFAULT_COLOUR = "#0ea5e9"
COUNTRY_NODE_COLOUR = "#f97316"
PRICE_NODE_COLOUR = "#10b981"
PRICE_NODE_ID = "p:current"
PRICE_NODE_LABEL = "Current Price"
COUNTRY_NODE_BASE_SIZE = 25.0
EVENT_NODE_BASE_SIZE = 15.0
EVENT_NODE_IMPACT_SCALE = 15.0
PRICE_NODE_SIZE = 20.0
DEFAULT_EDGE_WEIGHT = 0.5
DEFAULT_EDGE_WIDTH_SETTING = 2.0
LABEL_PREFIX_CHARS = 20
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+\z"   # JS `$` = end of text, so `\z` in Java
# ---------------------------------------------------------------------------

COUNTRY = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("coordinates", T.StructType([
        T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType())])),
    T.StructField("oilProduction", T.DoubleType()),
    T.StructField("oilReserves", T.DoubleType()),
    T.StructField("economicIndicators", T.StructType([
        T.StructField("gdp", T.DoubleType()),
        T.StructField("inflationRate", T.DoubleType()),
        T.StructField("currencyCode", T.StringType())])),
])

IMPACT = T.StructType([
    T.StructField("immediate", T.DoubleType()),
    T.StructField("shortTerm", T.DoubleType()),
    T.StructField("longTerm", T.DoubleType()),
])

EVENT = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("countries", T.ArrayType(T.StringType())),
    T.StructField("eventType", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("sentimentScore", T.DoubleType()),
    T.StructField("sourceUrl", T.StringType()),
    T.StructField("impact", IMPACT),
])

PRICE = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("priceType", T.StringType()),
    T.StructField("volume", T.DoubleType()),
    T.StructField("change", T.StructType([
        T.StructField("absolute", T.DoubleType()),
        T.StructField("percentage", T.DoubleType())])),
])

FACTOR = T.StructType([
    T.StructField("factor", T.StringType()),
    T.StructField("impact", T.DoubleType()),
    T.StructField("confidence", T.DoubleType()),
])

PREDICTION = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("prediction", T.StructType([
        T.StructField("price", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("timeHorizon", T.StringType()),
        T.StructField("trend", T.StringType())])),
    T.StructField("explanation", T.StructType([
        T.StructField("primaryFactors", T.ArrayType(FACTOR)),
        T.StructField("keyEvents", T.ArrayType(T.StringType())),
        T.StructField("affectedCountries", T.ArrayType(T.StringType()))])),
    T.StructField("metadata", T.StructType([
        T.StructField("modelVersion", T.StringType()),
        T.StructField("dataQuality", T.DoubleType()),
        T.StructField("featureImportance", T.MapType(T.StringType(), T.DoubleType()))])),
])

EDGE = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("type", T.StringType()),
])
