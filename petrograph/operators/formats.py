"""Scalar formatting functions applied as report columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrograph.functions import exprs as X
from petrograph.functions import sqltext as Q
from petrograph.plans.registry import query
from petrograph.sources.tables import read_table
from petrograph.sources.views import v_event, v_prediction, v_price

AS_OF = "2024-02-01 00:00:00"


@query("fmt_number", "X1", sql=f"""
SELECT c_custkey, {Q.fmt_number('c_acctbal')} AS acctbal_text, {Q.fmt_number('c_acctbal * 1000')} AS milli_text
FROM customer""")
def fmt_number(spark: SparkSession, d: str) -> DataFrame:
    """en-US grouping, at most 3 decimals."""
    c = read_table(spark, d, "customer", "c_custkey", "c_acctbal")
    return c.select("c_custkey", X.fmt_number("c_acctbal").alias("acctbal_text"),
                    X.fmt_number(F.col("c_acctbal") * 1000).alias("milli_text"))


@query("fmt_currency", "X2", sql=f"""
SELECT c_custkey, {Q.fmt_currency('c_acctbal')} AS acctbal_usd FROM customer""")
def fmt_currency(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer", "c_custkey", "c_acctbal")
    return c.select("c_custkey", X.fmt_currency("c_acctbal").alias("acctbal_usd"))


@query("fmt_percentage", "X3", sql=f"""
SELECT id, {Q.pct_text('confidence', 1)} AS confidence_pct, {Q.pct_text('confidence', 2)} AS confidence_pct2
FROM v_prediction""")
def fmt_percentage(spark: SparkSession, d: str) -> DataFrame:
    p = v_prediction(spark, d)
    return p.select("id", X.fmt_percentage("confidence", 1).alias("confidence_pct"),
                    X.fmt_percentage("confidence", 2).alias("confidence_pct2"))


@query("time_ago", "X4", sql=f"""
SELECT id, {Q.elapsed_seconds('ts', f"TIMESTAMP '{AS_OF}'")} AS age_s, {Q.time_ago('ts', f"TIMESTAMP '{AS_OF}'")} AS ago
FROM v_event""")
def time_ago(spark: SparkSession, d: str, as_of: str = AS_OF) -> DataFrame:
    """Age text against an explicit ``as_of`` (never now())."""
    ref = X.ts_ntz(as_of)
    return v_event(spark, d).select("id", X.elapsed_seconds("ts", ref).alias("age_s"),
                                    X.time_ago("ts", ref).alias("ago"))


@query("truncate_text", "X5", sql=f"""
SELECT id, {Q.truncate_text('title', 12)} AS short_title FROM v_event""")
def truncate_text(spark: SparkSession, d: str, n: int = 12) -> DataFrame:
    return v_event(spark, d).select("id", X.truncate_text("title", n).alias("short_title"))


_EMAIL_SQL = ("replace(c_name, '#', CASE c_custkey % 3 WHEN 0 THEN '@' WHEN 1 THEN '@x.' ELSE '' END)")


@query("valid_email", "X6", sql=f"""
SELECT regexp_matches({_EMAIL_SQL}, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+\\z') AS valid, count(*) AS n
FROM customer GROUP BY 1""")
def valid_email(spark: SparkSession, d: str) -> DataFrame:
    """Email-shape rule as a data-quality count."""
    c = read_table(spark, d, "customer", "c_custkey", "c_name")
    r = F.col("c_custkey") % 3
    email = F.replace(F.col("c_name"), F.lit("#"),
                      F.when(r == 0, F.lit("@")).when(r == 1, F.lit("@x.")).otherwise(F.lit("")))
    return (c.select(X.valid_email(email).alias("valid"))
            .groupBy("valid").agg(F.count(F.lit(1)).alias("n")))


@query("label_prefix", "X7", sql=f"SELECT id, {Q.label_prefix('title')} AS label FROM v_event")
def label_prefix(spark: SparkSession, d: str) -> DataFrame:
    return v_event(spark, d).select("id", X.label_prefix("title").alias("label"))


@query("round_fixed", "X9", sql=f"""
SELECT id, {Q.round_fixed('price', 2)} AS price_2dp, {Q.round_fixed('price', 0)} AS price_0dp,
       {Q.to_fixed('price', 2)} AS price_text FROM v_price""")
def round_fixed(spark: SparkSession, d: str) -> DataFrame:
    return v_price(spark, d).select("id", X.round_fixed("price", 2).alias("price_2dp"),
                                    X.round_fixed("price", 0).alias("price_0dp"),
                                    X.to_fixed("price", 2).alias("price_text"))
