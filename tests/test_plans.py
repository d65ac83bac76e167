"""Plan-shape checks: no nested-loop or cartesian joins anywhere, filters and
column pruning reach the Parquet scan, broadcast only on bounded sides."""

from __future__ import annotations

import re

import pytest

from petrograph.operators.graph import endpoint_flags, incident_edges_of
from petrograph.operators.lookups import match_all, search_entities
from petrograph.plans.inspect import global_windows, op_counts, plan_text
from petrograph.plans.registry import load_all
from tests.conftest import SF001

REG = load_all()
# Queries that execute a stream / model / write while being built are
# checked by the oracle tests instead.
EAGER = {"snapshot_write", "forecast_train_score", "forecast_explanation", "throttle_events",
         "node_ordinals", "stream_debounce", "forecast_backtest", "dq_quarantine", "stream_live_feed", "stream_alerts", "stream_event_windows", "stream_price_change"}
LAZY = sorted(set(REG) - EAGER)


@pytest.mark.parametrize("name", LAZY)
def test_no_nested_loop_or_cartesian(spark, name):
    plan = plan_text(REG[name].build(spark, SF001))
    assert "BroadcastNestedLoopJoin" not in plan
    assert "CartesianProduct" not in plan


@pytest.mark.parametrize("name", LAZY)
def test_global_windows_only_over_aggregates(spark, name):
    # A window without PARTITION BY runs in one task; it is allowed only over
    # an aggregated (bucket / partition-count) table.
    assert global_windows(REG[name].build(spark, SF001)) == []


def test_date_filter_pushed_to_scan(spark):
    plan = plan_text(REG["events_by_date_range"].build(spark, SF001))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_projection_pruned_at_scan(spark):
    plan = plan_text(REG["event_severity_band"].build(spark, SF001))
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan or \
        "ReadSchema: struct<event_id:bigint,event_type:string,value:double>" in plan


def test_country_lookup_is_broadcast(spark):
    plan = plan_text(REG["event_country_codes"].build(spark, SF001))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_global_window_detector_flags_raw_rows(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    df = spark.range(100).withColumn("r", F.row_number().over(Window.orderBy("id")))
    assert global_windows(df) != []
    agg = spark.range(100).groupBy((F.col("id") % 7).alias("b")).count()
    assert global_windows(agg.withColumn("r", F.row_number().over(Window.orderBy("b")))) == []


@pytest.fixture
def no_auto_broadcast(spark):
    """The joins that Spark would pick for large tables; explicit broadcasts stay."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_current_price_shuffles_no_fact_rows(spark, no_auto_broadcast):
    counts = op_counts(REG["current_price"].build(spark, SF001))
    assert "SortMergeJoin" not in counts
    # every exchange is one of a partial aggregate
    assert counts["Exchange"] <= counts["HashAggregate"] // 2


@pytest.mark.parametrize("name", ["incident_edges_by_node_type", "subgraph_by_node_type"])
def test_country_subgraph_has_no_shuffled_join(spark, no_auto_broadcast, name):
    assert "SortMergeJoin" not in op_counts(REG[name].build(spark, SF001))


@pytest.mark.parametrize("name", ["edges_with_endpoints", "dangling_edges"])
def test_endpoint_joins_spread_hubs(spark, no_auto_broadcast, name):
    plan = plan_text(REG[name].build(spark, SF001))
    assert not re.search(r"hashpartitioning\((source|target)#", plan)


def test_repeated_nodes_do_not_multiply_edges(spark):
    nodes = spark.createDataFrame([("c:A", "country"), ("c:A", "country"), ("e:1", "event"), ("e:1", "event")],
                                  "id string, type string")
    edges = spark.createDataFrame([("x", "e:1", "c:A", 1.0, "t"), ("y", "e:1", "p:1", 1.0, "t"),
                                   ("z", None, "c:A", 1.0, "t"), ("w", None, None, 1.0, "t")],
                                  "id string, source string, target string, weight double, type string")
    flags = {r.id: (r.src_hit, r.dst_hit) for r in endpoint_flags(edges, nodes).collect()}
    assert endpoint_flags(edges, nodes).count() == 4
    assert flags == {"x": (True, True), "y": (True, False), "z": (False, True), "w": (False, False)}
    assert sorted(r.id for r in incident_edges_of(nodes, edges, "country").collect()) == ["x", "z"]
    assert sorted(r.id for r in incident_edges_of(nodes, edges, "event").collect()) == ["x", "y"]


def test_struct_filter_compares_fields(spark):
    rows = spark.createDataFrame([(1, (1.5, "a")), (2, (None, "a")), (3, None)], "id long, s struct<x:double,y:string>")
    pick = lambda f: [r.id for r in rows.where(match_all(f)).collect()]
    assert pick({"s": {"x": 1.5, "y": "a"}}) == [1]
    assert pick({"s": {"y": "a"}}) == [1, 2] and pick({"s": {"x": None, "y": "a"}}) == [2]


def test_search_finds_predictions(spark):
    kinds = {r.kind for r in search_entities(spark, SF001, "24H").select("kind").distinct().collect()}
    assert "prediction" in kinds
