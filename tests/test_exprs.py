"""Semantics of the scalar helpers: rounding, formats, bands,
defaulting, time, regex and array edge cases."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from petrograph.functions import exprs as X
from petrograph.operators.lookups import has_member


def _one(spark, col, value, ddl="x double"):
    return spark.createDataFrame([(value,)], ddl).select(col.alias("r")).first()["r"]


@pytest.mark.parametrize("v,n,expected", [
    (1.005, 2, 1.0),        # binary value of 1.005 is just below the tie
    (0.125, 2, 0.13),       # exact binary tie rounds away from zero
    (-0.125, 2, -0.13),
    (2.5, 0, 3.0),
    (-2.5, 0, -3.0),
    (1234567.891, 1, 1234567.9),
    (None, 2, None),
])
def test_round_fixed(spark, v, n, expected):
    assert _one(spark, X.round_fixed("x", n), v) == expected


def test_round_fixed_large_values_stay_double(spark):
    assert _one(spark, X.round_fixed("x", 9), 8.0e12) == 8.0e12


@pytest.mark.parametrize("v,n,expected", [
    (78.45, 2, "78.45"), (0.0, 1, "0.0"), (-0.004, 2, "-0.00"), (2.5, 0, "3"), (9.995, 2, "9.99"),
    (-12.5, 1, "-12.5"),
])
def test_to_fixed(spark, v, n, expected):
    assert _one(spark, X.to_fixed("x", n), v) == expected


@pytest.mark.parametrize("v,expected", [
    (1234.5, "1,234.5"), (0.0, "0"), (-1234567.8915, "-1,234,567.892"), (12.0, "12"), (0.1, "0.1"),
])
def test_fmt_number(spark, v, expected):
    assert _one(spark, X.fmt_number("x"), v) == expected


@pytest.mark.parametrize("v,expected", [(1234.5, "$1,234.50"), (-1.0, "-$1.00"), (0.125, "$0.13")])
def test_fmt_currency(spark, v, expected):
    assert _one(spark, X.fmt_currency("x"), v) == expected


def test_pct_text(spark):
    assert _one(spark, X.fmt_percentage("x", 1), 0.94) == "94.0%"
    assert _one(spark, X.pct_text("x", 0), 0.40) == "40%"


@pytest.mark.parametrize("delta_s,expected", [
    (0, "0s ago"), (59, "59s ago"), (60, "1m ago"), (3599, "59m ago"), (3600, "1h ago"),
    (86399, "23h ago"), (86400, "1d ago"), (-5, "-5s ago"),
])
def test_time_ago(spark, delta_s, expected):
    as_of = dt.datetime(2024, 2, 1)
    ts = as_of - dt.timedelta(seconds=delta_s)
    df = spark.createDataFrame([(ts,)], "ts timestamp_ntz")
    assert df.select(X.time_ago("ts", X.ts_ntz("2024-02-01 00:00:00"))).first()[0] == expected


def test_time_ago_floors_fractional_seconds(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 31, 23, 59, 59, 500000),)], "ts timestamp_ntz")
    assert df.select(X.elapsed_seconds("ts", X.ts_ntz("2024-02-01 00:00:00"))).first()[0] == 0
    df = spark.createDataFrame([(dt.datetime(2024, 2, 1, 0, 0, 0, 500000),)], "ts timestamp_ntz")
    assert df.select(X.elapsed_seconds("ts", X.ts_ntz("2024-02-01 00:00:00"))).first()[0] == -1


def test_truncate_and_label(spark):
    assert _one(spark, X.truncate_text("x", 5), "hello", "x string") == "hello"
    assert _one(spark, X.truncate_text("x", 5), "hello!", "x string") == "hello..."
    assert _one(spark, X.label_prefix("x", 20), "short", "x string") == "short..."


@pytest.mark.parametrize("s,ok", [("a@b.co", True), ("a@b", False), ("a b@c.d", False),
                                  ("a@b.c\n", False), ("@b.c", False)])
def test_valid_email(spark, s, ok):
    assert _one(spark, X.valid_email("x"), s, "x string") is ok


@pytest.mark.parametrize("v,zero,half", [(None, 0.0, 0.5), (float("nan"), 0.0, 0.5), (0.0, 0.0, 0.5),
                                         (0.3, 0.3, 0.3)])
def test_js_defaults(spark, v, zero, half):
    assert _one(spark, X.or_zero("x"), v) == zero
    assert _one(spark, X.or_default("x", 0.5), v) == half


@pytest.mark.parametrize("w,band", [(0.81, "strong"), (0.8, "medium"), (0.61, "medium"), (0.6, "weak")])
def test_strength_band_is_strict(spark, w, band):
    assert _one(spark, X.strength_band("x"), w) == band


@pytest.mark.parametrize("v,band", [(0.71, "red"), (0.7, "yellow"), (0.41, "yellow"), (0.4, "green"), (None, None)])
def test_impact_band_is_strict(spark, v, band):
    assert _one(spark, X.impact_band("x"), v) == band


def test_severity_band_default(spark):
    assert _one(spark, X.severity_band("x"), "unknown", "x string") == "gray"
    assert _one(spark, X.severity_band("x"), "high", "x string") == "orange"


def test_array_membership_is_boolean(spark):
    df = spark.createDataFrame([(["a", None],), (None,), ([],)], "c array<string>")
    assert [r[0] for r in df.select(has_member("c", "b")).collect()] == [False, False, False]


def test_nan_not_null(spark):
    assert math.isnan(_one(spark, F.col("x") + 0, float("nan")))
