"""Readers of one's own countries, events, prices and predictions (S1-S3), JSON or Parquet.

Files are read with the declared nested schema (``schemas``), never an inferred one.  Every row is either
loaded, mapped to the flat columns that the operators use, or rejected with its reasons:

* ``malformed``: not JSON, or a value that doesn't fit its declared type;
* ``missing <field>``: a field that must not be NULL is;
* ``outside <field>``: a value beyond its declared range or not among its declared values.

``Loaded.rejected`` keeps the rows as text beside their reasons.  Folders named ``day=...`` become a
column of that name, so a filter on it reads only those folders.

Both tables come from one scan each; nothing is cached.  A row is rejected for all its reasons at once.
Empty input gives two empty tables; fields that aren't declared are ignored; a Parquet file whose column
has another type is read if the values can be cast, and rejected row by row where one can't.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from petrograph import schemas as S

_CORRUPT = "_corrupt"


def _ntz(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz")


#: entity: flat column -> nested source, as the operators name them.
FLAT = {
    "country": {"id": "id", "name": "name", "code": "code", "lat": "coordinates.lat", "lng": "coordinates.lng",
                "oil_production": "oilProduction", "oil_reserves": "oilReserves", "gdp": "economicIndicators.gdp",
                "inflation_rate": "economicIndicators.inflationRate", "currency_code": "economicIndicators.currencyCode"},
    "event": {"id": "id", "ts": "timestamp", "title": "title", "description": "description", "event_type": "eventType",
              "severity": "severity", "sentiment": "sentimentScore", "source_url": "sourceUrl", "countries": "countries",
              "immediate": "impact.immediate", "short_term": "impact.shortTerm", "long_term": "impact.longTerm"},
    "price": {"ts": "timestamp", "price": "price", "currency": "currency", "price_type": "priceType", "volume": "volume",
              "change_abs": "change.absolute", "change_pct": "change.percentage"},
    "prediction": {"id": "id", "ts": "timestamp", "price": "prediction.price", "confidence": "prediction.confidence",
                   "horizon": "prediction.timeHorizon", "trend": "prediction.trend",
                   "primary_factors": "explanation.primaryFactors", "key_events": "explanation.keyEvents",
                   "affected_countries": "explanation.affectedCountries", "model_version": "metadata.modelVersion",
                   "data_quality": "metadata.dataQuality", "feature_importance": "metadata.featureImportance"},
}
SCHEMAS = {"country": S.COUNTRY, "event": S.EVENT, "price": S.PRICE, "prediction": S.PREDICTION}
#: Fields that must be there.
REQUIRED = {"country": ("id", "name", "code"), "event": ("id", "title", "timestamp", "severity"),
            "price": ("timestamp", "price", "priceType"), "prediction": ("id", "timestamp", "prediction.price")}
#: Declared values and ranges; NULL passes.
DOMAINS = {"event": {"eventType": S.EVENT_TYPES, "severity": S.SEVERITIES}, "price": {"priceType": S.PRICE_TYPES},
           "prediction": {"prediction.timeHorizon": S.HORIZONS, "prediction.trend": S.TRENDS}}
RANGES = {"event": {"sentimentScore": (-1, 1)}, "prediction": {"prediction.confidence": (0, 1)}}


@dataclass(frozen=True)
class Loaded:
    rows: DataFrame         # flat columns
    rejected: DataFrame     # reasons array<string>, raw string


def _fits(have: T.DataType, want: T.DataType, c: Column) -> tuple[Column, Column]:
    """(value as the declared type, whether a value was lost)."""
    if have == want:
        return c, F.lit(False)
    text = want.simpleString()
    cast = F.try_to_timestamp(c.cast("string")) if isinstance(want, T.TimestampType) and isinstance(have, T.StringType) \
        else c.try_cast(text)
    return cast, c.isNotNull() & cast.isNull()


def _declared(spark: SparkSession, path: str, entity: str, fmt: str) -> tuple[DataFrame, list[str]]:
    """Rows with the declared fields, ``_raw`` and ``_lost`` (malformed), and the names of partition columns."""
    schema = SCHEMAS[entity]
    if fmt == "json":
        nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
        df = (spark.read.schema(nullable.add(_CORRUPT, "string")).option("columnNameOfCorruptRecord", _CORRUPT)
              .option("mode", "PERMISSIVE").json(path))
        parts = [c for c in df.columns if c not in schema.names and c != _CORRUPT]
        raw = F.coalesce(F.col(_CORRUPT), F.to_json(F.struct(*schema.names)))
        return df.select(*schema.names, *parts, raw.alias("_raw"), F.col(_CORRUPT).isNotNull().alias("_lost")), parts
    if fmt != "parquet":
        raise ValueError(f"unknown format {fmt!r}")
    df = spark.read.parquet(path)
    have = {f.name: f.dataType for f in df.schema}
    missing = [f.name for f in schema if f.name not in have and f.name in REQUIRED[entity]]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    values, lost = [], F.lit(False)
    for f in schema:
        if f.name in have:
            value, bad = _fits(have[f.name], f.dataType, F.col(f.name))
            values.append(value.alias(f.name))
            lost = lost | bad
        else:
            values.append(F.lit(None).cast(f.dataType).alias(f.name))
    parts = [c for c in have if c in ("day", "month") and c not in schema.names]
    raw = F.to_json(F.struct(*[c for c in have if c not in parts]))
    return df.select(*values, *parts, raw.alias("_raw"), lost.alias("_lost")), parts


def reasons(entity: str) -> Column:
    """array<string>: what is wrong with a declared row."""
    rules = [F.when(F.col("_lost"), F.lit("malformed"))]
    # A row that could not be parsed misses everything; one reason is enough.
    rules += [F.when(~F.col("_lost") & F.col(c).isNull(), F.lit(f"missing {c}")) for c in REQUIRED[entity]]
    rules += [F.when(~F.col(c).isin(*values), F.lit(f"outside {c}")) for c, values in DOMAINS.get(entity, {}).items()]
    rules += [F.when(~F.col(c).between(low, high), F.lit(f"outside {c}")) for c, (low, high) in RANGES.get(entity, {}).items()]
    return F.filter(F.array(*rules), lambda r: r.isNotNull())


def read_entity(spark: SparkSession, path: str, entity: str, fmt: str = "json") -> Loaded:
    """The file or folder at ``path`` as one entity's rows and rejects."""
    rows, parts = _declared(spark, path, entity, fmt)
    judged = rows.withColumn("_reasons", reasons(entity))
    flat = [(_ntz(c) if c == "timestamp" else F.col(c)).alias(name) for name, c in FLAT[entity].items()]
    if entity == "price":
        # Prices have no id of their own; equal ones are one tick.
        flat.insert(0, F.xxhash64("priceType", "timestamp", "price").alias("id"))
    return Loaded(judged.filter(F.size("_reasons") == 0).select(*flat, *parts),
                  judged.filter(F.size("_reasons") > 0).select(F.col("_reasons").alias("reasons"), F.col("_raw").alias("raw")))
