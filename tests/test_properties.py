"""Structural properties on the sf0.01 data and
stream = batch equivalence."""

from __future__ import annotations

from pyspark.sql import functions as F

from petrograph.operators import graph as G
from petrograph.operators.sequences import debounce, price_changes
from petrograph.sources.tables import read_table
from petrograph.sources.views import v_country, v_event, v_tick
from petrograph.streaming.streams import stream_price_change
from tests.conftest import SF001


def test_node_count_is_sum_of_entities(spark):
    n = G.graph_nodes_df(spark, SF001).count()
    assert n == v_country(spark, SF001).count() + v_event(spark, SF001).count() + 1


def test_every_edge_resolves_or_is_dangling(spark):
    total = G.graph_edges_df(spark, SF001).count()
    resolved = G.edges_with_endpoints(spark, SF001).count()
    dangling = G.dangling_edges(spark, SF001).count()
    assert resolved + dangling == total


def test_subgraphs_cover_all_edges(spark):
    nodes, edges = G.graph_nodes_df(spark, SF001), G.graph_edges_df(spark, SF001)
    covered = None
    for t in ("country", "event", "price_point"):
        ids = G.incident_edges_of(nodes, edges, t).select("id")
        covered = ids if covered is None else covered.unionByName(ids)
    dangling = G.dangling_edges(spark, SF001)
    # an edge is uncovered only if neither endpoint is a node
    uncovered = edges.select("id").subtract(covered.distinct())
    both_missing = dangling.where("missing_source AND missing_target").select("id")
    assert uncovered.subtract(both_missing).count() == 0


def test_band_counts_sum_to_edge_count(spark):
    edges = G.graph_edges_df(spark, SF001)
    assert G.strength_histogram(edges).agg(F.sum("n_edges")).first()[0] == edges.count()


def test_debounce_subset_and_keeps_last_per_key(spark):
    e = read_table(spark, SF001, "events", "event_id", "user_id", "ts").withColumnRenamed("event_id", "id")
    kept = debounce(e, "user_id", 300)
    assert kept.join(e, "id", "left_anti").count() == 0
    last = e.groupBy("user_id").agg(F.max_by("id", F.struct("ts", "id")).alias("id"))
    assert last.join(kept, "id", "left_anti").count() == 0


def test_incident_counts_total(spark):
    edges = G.graph_edges_df(spark, SF001)
    loops = edges.where(F.col("source") == F.col("target")).count()
    total = G.incident_counts(edges).agg(F.sum("n_edges")).first()[0]
    assert total == 2 * edges.count() - loops


def test_stream_price_change_equals_batch(spark):
    stream = stream_price_change(spark, SF001)
    batch = price_changes(v_tick(spark, SF001))
    cols = ["id", "price_type", "price", "prev_price", "change_abs", "change_pct"]
    assert stream.select(*cols).exceptAll(batch.select(*cols)).count() == 0
    assert batch.select(*cols).exceptAll(stream.select(*cols)).count() == 0


def test_snapshot_is_day_partitioned_and_prunes(spark):
    from petrograph.operators.scans import _snapshot_frames, write_snapshot
    from petrograph.plans.inspect import plan_text
    from petrograph.plans.storage import scratch_path

    paths = write_snapshot(_snapshot_frames(spark, SF001), scratch_path(spark, "snapshot-test"))
    ev = spark.read.parquet(paths["event"])
    assert ev.count() == v_event(spark, SF001).count()
    q = ev.where(F.col("day") == F.lit("2024-01-05").cast("date"))
    assert "PartitionFilters: [isnotnull(day" in plan_text(q)
    assert q.count() == v_event(spark, SF001).where(F.to_date("ts") == F.lit("2024-01-05").cast("date")).count()
