"""Golden checks: the modelled application's sample records through the
library's operators, against the expectations in FIXTURES.md §2."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from petrograph.functions import exprs as X
from petrograph.operators.aggregates import kpis_of
from petrograph.operators.graph import (graph_stats_of, incident_counts, strength_histogram, subgraph_of)
from petrograph.operators.lookups import has_member, in_range, match_all
from petrograph.operators.reports import overflow, with_country_codes
from petrograph.operators.sequences import latest_two, price_changes
from tests import reference_fixtures as R


def _ids(df):
    return {r[0] for r in df.select("id").collect()}


def test_events_by_country(spark):
    ev = R.events(spark)
    assert _ids(ev.where(has_member("countries", "russia"))) == {"event_1", "event_2"}
    assert _ids(ev.where(has_member("countries", "usa"))) == {"event_1", "event_3"}
    assert _ids(ev.where(has_member("countries", "china"))) == {"event_4"}


def test_events_by_severity_and_date(spark):
    ev = R.events(spark)
    assert _ids(ev.where(F.col("severity") == "medium")) == {"event_3", "event_4"}
    assert _ids(ev.where(F.col("severity") == "low")) == set()
    # A date-only end bound is midnight, so event_2 at 09:15 on the 14th is out.
    assert _ids(ev.where(in_range("ts", "2024-01-13 00:00:00", "2024-01-14 00:00:00"))) == {"event_3"}
    assert _ids(ev.where(in_range("ts", "2024-01-14 09:15:00", "2024-01-14 09:15:00"))) == {"event_2"}


def test_country_by_filter(spark):
    c = R.countries(spark)
    assert c.where(match_all({})).count() == 6
    assert _ids(c.where(match_all({"code": "IR"}))) == {"iran"}


def test_event_country_codes_and_bands(spark):
    ev = with_country_codes(R.events(spark), R.countries(spark))
    out = {r["id"]: r for r in ev.select(
        "id", "codes", overflow("countries").alias("overflow"),
        X.impact_band("immediate").alias("band"), X.pct_text("immediate", 0).alias("pct")).collect()}
    assert out["event_1"]["codes"] == "US,RU"
    assert out["event_2"]["codes"] == "SA,RU"
    assert out["event_3"]["codes"] == "IR,US"
    assert out["event_4"]["codes"] == "CN"
    assert all(r["overflow"] == 0 for r in out.values())
    assert [(out[k]["band"], out[k]["pct"]) for k in ("event_1", "event_2", "event_3", "event_4")] == [
        ("red", "95%"), ("red", "80%"), ("green", "40%"), ("yellow", "50%")]


def test_price_change_recomputed(spark):
    rows = price_changes(R.prices(spark)).orderBy("ts").collect()
    assert rows[0]["change_abs"] is None and rows[0]["change_pct"] is None
    assert (rows[1]["change_abs"], rows[1]["change_pct"]) == (-0.45, -0.59)
    assert (rows[2]["change_abs"], rows[2]["change_pct"]) == (2.15, 2.82)


def test_dashboard_kpis(spark):
    prices = R.prices(spark)
    t = latest_two(prices, ["price_type"], ["ts", "id"], ["price"])
    diff = F.col("price") - F.col("prev_price")
    current = t.select("price_type", "id", "ts", "price",
                       X.round_fixed(F.try_divide(diff, F.col("prev_price")) * 100, 2).alias("change_pct"))
    preds = spark.createDataFrame([(1, dt.datetime(2024, 1, 15, 15, 30), 0.94)],
                                  "id long, ts timestamp_ntz, confidence double")
    k = kpis_of(current, R.events(spark), R.countries(spark), preds).first()
    assert (k["current_price"], k["change_pct"], k["critical_events"], k["active_countries"],
            k["model_confidence"]) == (78.45, 2.82, 1, 6, 0.94)


def test_prediction_top_factors(spark):
    p = spark.createDataFrame([(R.PREDICTION["id"], R.PREDICTION["primaryFactors"])],
                              "id string, f array<struct<factor:string,impact:double,confidence:double>>")
    got = [r[0] for r in p.select(F.explode(F.slice("f", 1, 3)).alias("x"))
           .select(X.pct_text("x.impact", 0)).collect()]
    assert got == ["75%", "65%", "35%"]


def test_graph_nodes(spark):
    nodes, edges = R.graph(spark)
    n = {r["id"]: r for r in nodes.collect()}
    assert len(n) == 11
    assert n["c:usa"]["size"] == 44.5
    assert abs(n["c:saudi_arabia"]["size"] - 37.3) < 1e-9
    assert n["e:event_1"]["label"] == "US Sanctions on Russ..."
    assert n["e:event_1"]["size"] == 29.25
    assert n["e:event_4"]["size"] == 22.5
    assert n["p:current"]["price"] == 78.45


def test_graph_stats_and_histogram(spark):
    nodes, edges = R.graph(spark)
    s = graph_stats_of(nodes, edges).first()
    assert (s["n_nodes"], s["n_edges"], s["high_impact_events"]) == (11, 10, 2)
    assert abs(s["avg_weight"] - 0.76) < 1e-9
    h = {r["band"]: r["n_edges"] for r in strength_histogram(edges).collect()}
    assert h == {"strong": 4, "medium": 4, "weak": 2}   # 0.80 is medium (strict rule)


def test_subgraphs(spark):
    nodes, edges = R.graph(spark)
    for t, (n_nodes, n_edges) in {"country": (6, 6), "event": (4, 10), "price_point": (1, 4)}.items():
        rows = subgraph_of(nodes, edges, t).groupBy("element").count().collect()
        got = {r["element"]: r["count"] for r in rows}
        assert (got.get("node", 0), got.get("edge", 0)) == (n_nodes, n_edges), t
    assert subgraph_of(nodes, edges, "all").count() == 21


def test_incident_counts_cover_edges(spark):
    nodes, edges = R.graph(spark)
    total = incident_counts(edges).agg(F.sum("n_edges")).first()[0]
    assert total == 2 * edges.count()   # no self-loops: each edge counted at both ends


def test_membership_without_edge(spark):
    ev = R.events(spark).select("id", F.explode("countries").alias("c"))
    lit = spark.createDataFrame([(s, t) for s, t, _, _ in R.COUNTRY_EVENT_EDGES], "c string, id string")
    missing = ev.join(lit, ["c", "id"], "left_anti").collect()
    assert [(r["id"], r["c"]) for r in missing] == [("event_3", "usa")]
