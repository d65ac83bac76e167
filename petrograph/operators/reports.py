"""Event report rows: country-code enrichment, bands, top-k (D1-D3, D10,
J1, A2, K1, K3).

Country codes come from two broadcast lookups against the 25-row country
dimension (array elements 1 and 2), so enrichment needs no explode and no
re-grouping shuffle; the event side is never moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrograph.functions import exprs as X
from petrograph.functions import sqltext as Q
from petrograph.plans.registry import query
from petrograph.sources.views import country_dim, v_event


def overflow(countries) -> F.Column:
    """``+N`` for more than two countries: greatest(len-2, 0), NULL -> 0."""
    return F.greatest(F.coalesce(F.size(countries) - 2, F.lit(0)), F.lit(0)).cast("long")


def with_country_codes(events: DataFrame, countries: DataFrame, n: int = 2) -> DataFrame:
    """Add ``codes``: the first ``n`` country ids shown as codes, comma separated.

    An id with no country (or an empty code) is shown as the raw id, order is
    kept.  ``countries`` must be the bounded country dimension (broadcast).
    """
    dim = F.broadcast(countries.select("id", "code"))
    out = events
    parts = []
    for i in range(n):
        cid, code = f"_cid{i}", f"_code{i}"
        lk = dim.select(F.col("id").alias(cid + "_k"), F.col("code").alias(code))
        out = (out.withColumn(cid, F.get(F.col("countries"), i))
               .join(lk, F.col(cid) == F.col(cid + "_k"), "left").drop(cid + "_k"))
        parts.append(F.coalesce(F.nullif(F.col(code), F.lit("")), F.col(cid)))
    drop = [c for i in range(n) for c in (f"_cid{i}", f"_code{i}")]
    return out.withColumn("codes", F.concat_ws(",", *parts)).drop(*drop)


def _codes_sql(alias: str = "e") -> tuple[str, str]:
    sel = (f"concat_ws(',', coalesce(nullif(c1.code, ''), {alias}.countries[1]), "
           f"coalesce(nullif(c2.code, ''), {alias}.countries[2])) AS codes")
    joins = (f"LEFT JOIN v_country c1 ON c1.id = {alias}.countries[1] "
             f"LEFT JOIN v_country c2 ON c2.id = {alias}.countries[2]")
    return sel, joins


def _overflow_sql(e: str = "countries") -> str:
    return f"CAST(greatest(coalesce(len({e}) - 2, 0), 0) AS BIGINT)"


def top_recent(df: DataFrame, n: int) -> DataFrame:
    """Latest ``n`` rows by (ts, id): a TakeOrderedAndProject, no full shuffle."""
    return df.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(n)


_CODES_SEL, _CODES_JOIN = _codes_sql()


@query("event_report", "D10", sql=f"""
SELECT e.id, e.ts, e.title, {_CODES_SEL}, {_overflow_sql('e.countries')} AS overflow, e.severity,
       {Q.severity_band('e.severity')} AS severity_colour, {Q.impact_band('e.immediate')} AS impact_band,
       {Q.pct_text('e.immediate', 0)} AS impact_pct
FROM (SELECT * FROM v_event ORDER BY ts DESC, id DESC LIMIT 5) e {_CODES_JOIN}""")
def event_report(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: the 5 most recent events as report rows."""
    return event_report_of(v_event(spark, d), country_dim(spark, d))


def event_report_of(events: DataFrame, countries: DataFrame, n: int = 5) -> DataFrame:
    """The n most recent events; their description too, where the events have one."""
    told = ["description"] if "description" in events.columns else []
    return (with_country_codes(top_recent(events, n), countries)
            .select("id", "ts", "title", *told, "codes", overflow("countries").alias("overflow"), "severity",
                    X.severity_band("severity").alias("severity_colour"),
                    X.impact_band("immediate").alias("impact_band"),
                    X.pct_text("immediate", 0).alias("impact_pct")))


@query("event_country_codes", "J1", sql=f"""
SELECT e.id, {_CODES_SEL}, {_overflow_sql('e.countries')} AS overflow
FROM v_event e {_CODES_JOIN}""")
def event_country_codes(spark: SparkSession, d: str) -> DataFrame:
    ev = v_event(spark, d).select("id", "countries")
    return (with_country_codes(ev, country_dim(spark, d))
            .select("id", "codes", overflow("countries").alias("overflow")))


@query("event_country_overflow", "A2", sql=f"""
SELECT id, CAST(len(countries) AS BIGINT) AS n_countries, {_overflow_sql()} AS overflow FROM v_event""")
def event_country_overflow(spark: SparkSession, d: str) -> DataFrame:
    return v_event(spark, d).select("id", F.size("countries").cast("long").alias("n_countries"),
                                    overflow("countries").alias("overflow"))


@query("event_first_countries", "K3", sql="""
SELECT id, array_to_string(list_slice(countries, 1, 2), ',') AS first_countries FROM v_event""")
def event_first_countries(spark: SparkSession, d: str) -> DataFrame:
    return v_event(spark, d).select(
        "id", F.concat_ws(",", F.slice("countries", 1, 2)).alias("first_countries"))


@query("recent_events_top5", "K1", sql="""
SELECT id, ts, title, severity FROM v_event ORDER BY ts DESC, id DESC LIMIT 5""")
def recent_events_top5(spark: SparkSession, d: str) -> DataFrame:
    return top_recent(v_event(spark, d), 5).select("id", "ts", "title", "severity")


@query("event_severity_band", "D1", sql=f"""
SELECT id, severity, {Q.severity_band('severity')} AS severity_colour FROM v_event""")
def event_severity_band(spark: SparkSession, d: str) -> DataFrame:
    return v_event(spark, d).select("id", "severity", X.severity_band("severity").alias("severity_colour"))


@query("event_impact_band", "D2", sql=f"""
SELECT id, immediate, {Q.impact_band('immediate')} AS impact_band FROM v_event""")
def event_impact_band(spark: SparkSession, d: str) -> DataFrame:
    return v_event(spark, d).select("id", "immediate", X.impact_band("immediate").alias("impact_band"))


@query("event_impact_pct", "D3", sql=f"""
SELECT id, {Q.pct_text('immediate', 0)} AS impact_pct FROM v_event""")
def event_impact_pct(spark: SparkSession, d: str) -> DataFrame:
    return v_event(spark, d).select("id", X.pct_text("immediate", 0).alias("impact_pct"))
