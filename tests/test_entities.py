"""Own entity files: declared schemas, rejects with reasons, partition folders, and the operators on top."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from petrograph.operators.graph import (EDGE_COLS, country_nodes_of, elements_of, event_nodes_of, nodes_of,
                                        price_node_of)
from petrograph.operators.reports import event_report_of
from petrograph.sources.entities import SCHEMAS, read_entity
from tests import reference_fixtures as R


def iso(ts):
    return ts.replace(" ", "T") + "Z"


def records():
    return {
        "country": [{"id": i, "name": n, "code": c, "oilProduction": p, "coordinates": {"lat": 1.5, "lng": -2}}
                    for i, n, c, p in R.COUNTRIES],
        "event": [{"id": i, "title": t, "description": f"About {t}", "timestamp": iso(ts), "countries": c, "severity": s,
                   "sentimentScore": x, "eventType": "economic", "impact": {"immediate": im}, "unknown": 1}
                  for i, t, ts, c, s, x, im in R.EVENTS],
        "price": [{"timestamp": iso(ts), "price": p, "currency": "USD", "priceType": t, "change": {"percentage": c}}
                  for ts, p, t, c in R.PRICES],
        "prediction": [{"id": R.PREDICTION["id"], "timestamp": iso(R.PREDICTION["timestamp"]),
                        "prediction": {"price": 79.85, "confidence": 0.94, "timeHorizon": "24h", "trend": "bullish"},
                        "explanation": {"primaryFactors": [dict(zip(("factor", "impact", "confidence"), f, strict=True))
                                                           for f in R.PREDICTION["primaryFactors"]],
                                        "keyEvents": ["event_1"], "affectedCountries": ["usa"]},
                        "metadata": {"modelVersion": "v1", "dataQuality": 0.9, "featureImportance": {"a": 0.5}}}]}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("entities")
    for name, rows in records().items():
        (at / f"{name}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    return at


def test_report_and_graph_from_json_files(spark, folder):
    got = {n: read_entity(spark, str(folder / f"{n}.json"), n) for n in records()}
    assert all(x.rejected.count() == 0 for x in got.values())
    rows = {n: x.rows for n, x in got.items()}
    report = event_report_of(rows["event"], rows["country"]).collect()
    assert [(r.id, r.codes, r.impact_pct, r.description) for r in report][:2] == [
        ("event_1", "US,RU", "95%", "About US Sanctions on Russian Oil Exports"),
        ("event_2", "SA,RU", "80%", "About OPEC+ Production Cut Agreement")]
    assert report[0].ts == dt.datetime(2024, 1, 15, 14, 30)
    nodes = nodes_of(country_nodes_of(rows["country"]), event_nodes_of(rows["event"]),
                     price_node_of(rows["price"].where("price_type = 'WTI'")))
    want_nodes, edges = R.graph(spark)
    assert nodes.select("id", "label", "size", "price").exceptAll(want_nodes.select("id", "label", "size", "price")).isEmpty()
    assert elements_of(nodes, edges.select(*EDGE_COLS)).count() == 11 + 10
    p = rows["prediction"].first()
    assert (p.horizon, p.primary_factors[0].factor, p.feature_importance) == ("24h", "OPEC+ Production Cut", {"a": 0.5})


def test_bad_rows_are_kept_apart_with_their_reasons(spark, tmp_path):
    good = records()["event"][0]
    lines = [json.dumps(good), "{not json", json.dumps(good | {"id": None, "severity": "huge"}),
             json.dumps(good | {"sentimentScore": 2.5}), json.dumps(good | {"impact": "much"}), json.dumps(good | {"timestamp": "soon"}),
             "", json.dumps(good | {"eventType": None, "id": "x"})]
    (tmp_path / "e.json").write_text("\n".join(lines))
    got = read_entity(spark, str(tmp_path / "e.json"), "event")
    assert sorted(r.id for r in got.rows.collect()) == ["event_1", "x"]
    bad = sorted((r.reasons, r.raw) for r in got.rejected.collect())
    assert [r for r, _ in bad] == [["malformed"], ["malformed"], ["malformed"], ["missing id", "outside severity"],
                                   ["outside sentimentScore"]]
    assert "{not json" in [raw for _, raw in bad]


def test_parquet_with_other_types_and_days(spark, tmp_path):
    rows = [("e1", "a", "2024-01-01 10:00:00", "high", "0.5", "2024-01-01"), ("e2", "b", "2024-01-02 10:00:00", "low", "x", "2024-01-02"),
            ("e3", "c", "2024-01-02 11:00:00", "low", None, "2024-01-02")]
    df = spark.createDataFrame(rows, "id string, title string, timestamp string, severity string, sentimentScore string, day string")
    df.write.partitionBy("day").parquet(str(tmp_path / "e"))
    got = read_entity(spark, str(tmp_path / "e"), "event", "parquet")
    assert sorted((r.id, r.sentiment, str(r.day)) for r in got.rows.collect()) == [("e1", 0.5, "2024-01-01"), ("e3", None, "2024-01-02")]
    assert [r.reasons for r in got.rejected.collect()] == [["malformed"]]
    plan = got.rows.where(F.col("day") == "2024-01-01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    with pytest.raises(ValueError, match="no column title"):
        df.drop("title").write.parquet(str(tmp_path / "f"))
        read_entity(spark, str(tmp_path / "f"), "event", "parquet")


def test_round_trip_and_empty(spark, folder, tmp_path):
    for name, schema in SCHEMAS.items():
        spark.read.schema(schema).json(str(folder / f"{name}.json")).write.parquet(str(tmp_path / name))
        a = read_entity(spark, str(folder / f"{name}.json"), name).rows
        b = read_entity(spark, str(tmp_path / name), name, "parquet").rows
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}-none"))
        none = read_entity(spark, str(tmp_path / f"{name}-none"), name, "parquet")
        assert none.rows.count() == 0 and none.rejected.count() == 0
