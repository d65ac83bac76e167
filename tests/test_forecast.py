"""Forecasts: horizons, folds without leaks, the factors of single forecasts, rounds of message passing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from petrograph.operators import forecast as M
from petrograph.operators.graph import graph_edges_df, graph_nodes_df
from petrograph.plans.inspect import plan_text
from tests.conftest import SF001, SF0001

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def fit(spark):
    return M.fitted(spark, SF001)


def walk(node, row):
    """(leaf value, steps by feature) of one tree, in plain Python."""
    steps = dict.fromkeys(M.FEATURES, 0.0)
    while node.subtreeDepth():
        f = M.FEATURES[node.split().featureIndex()]
        below = node.leftChild() if float(row[f]) <= node.split().threshold() else node.rightChild()
        steps[f] += below.prediction() - node.prediction()
        node = below
    return node.prediction(), steps


def test_contributions_add_up_to_the_forecast(spark, fit):
    data, model, cut = fit
    scored = M.explained(model.transform(data.limit(2000)), model).collect()
    assert all(abs(r.bias + sum(r.contributions.values()) - r.prediction) < 1e-9 for r in scored)
    trees, weights = model.stages[-1].trees, model.stages[-1].treeWeights
    roots = [t._call_java("rootNode") for t in trees]
    for r in scored[:100]:
        total, per_tree = dict.fromkeys(M.FEATURES, 0.0), []
        for root, w in zip(roots, weights, strict=True):
            steps = {f: w * x for f, x in walk(root, r)[1].items()}
            per_tree.append(steps)
            total = {f: total[f] + steps[f] for f in total}
        assert all(abs(total[f] - r.contributions[f]) < 1e-9 for f in total)
        size = sum(map(abs, total.values()))
        want = sorted((f for f in total if total[f]), key=lambda f: (-abs(total[f]), f))[:3]
        assert [x.factor for x in r.primary_factors] == want
        for x in r.primary_factors:
            used = [s[x.factor] for s in per_tree if s[x.factor]]
            assert abs(x.impact - total[x.factor] / size) < 1e-9 and -1 <= x.impact <= 1
            assert abs(x.confidence - sum((u > 0) == (total[x.factor] > 0) for u in used) / len(used)) < 1e-12


def test_every_scored_row_is_explained(spark, fit):
    scored, factors = M.forecast_train_score(spark, SF001), M.forecast_explanation(spark, SF001)
    assert {r.horizon for r in scored.select("horizon").distinct().collect()} == set(M.HORIZON_SECONDS)
    assert scored.count() == scored.select("id").distinct().count() == factors.where("position = 1").count()
    assert factors.where("abs(impact) > 1 or confidence < 0 or confidence > 1").isEmpty()


def test_request_of_one_horizon(spark, fit):
    got = M.requested(spark, SF001, "6h", include_explanation=True)
    assert [r.horizon for r in got.select("horizon").distinct().collect()] == ["6h"] and "primary_factors" in got.columns
    assert "primary_factors" not in M.requested(spark, SF001, "6h").columns
    with pytest.raises(ValueError, match="horizon must be"):
        M.requested(spark, SF001, "2h")


def test_labels_of_all_horizons(spark):
    rows = [(i, T0 + dt.timedelta(hours=i), "WTI", float(i)) for i in range(0, 200, 2)]
    ticks = spark.createDataFrame(rows, "id long, ts timestamp_ntz, price_type string, price double")
    got = {(r.id, r.horizon): r.label for r in M.labelled(ticks, ticks).collect()}
    for i, _, _, _ in rows:
        for h, s in M.HORIZON_SECONDS.items():
            due = i + s // 3600
            assert got[i, h] == (None if due > 198 else due - due % 2)


def test_training_knows_nothing_after_the_cut(spark, fit):
    data, _, cut = fit
    train = M.before(data, cut)
    known = train.select(F.max(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("horizon_s") * 1_000_000)).first()[0]
    assert known < cut
    # A signal that only the future holds: prices double after the cut, and training doesn't notice.
    later = F.unix_micros(F.col("ts").cast("timestamp")) >= F.lit(cut)
    ticks = M.v_tick(spark, SF001)
    planted = ticks.withColumn("price", F.when(later, F.col("price") * 1000).otherwise(F.col("price")))
    base = M.labelled(ticks, ticks)
    moved = M.labelled(planted, planted)
    cols = ["id", "horizon", "price", "label"]
    assert M.before(moved, cut).select(cols).exceptAll(M.before(base, cut).select(cols)).isEmpty()
    assert M.before(base, cut).count() > 100


def test_rolling_origin(spark, fit):
    got = {(r.fold, r.horizon): r for r in M.rolling_origin(fit[0], (0.5, 0.8)).collect()}
    assert {f for f, _ in got} == {0, 1} and {h for _, h in got} == set(M.HORIZON_SECONDS)
    assert all(r.n > 0 and r.rmse >= r.mae > 0 and 0 <= r.hit_rate <= 1 for r in got.values())
    assert got[0, "1h"].test_from < got[1, "1h"].test_from


def test_two_rounds_against_plain_python(spark):
    nodes = [("c:A", 1.0), ("c:B", 5.0), ("p:1", 7.0), ("e:1", 2.0), ("e:2", 4.0), ("e:3", 9.0)]
    edges = [("1", "c:A", "e:1", 0.5), ("2", "c:B", "e:1", None), ("3", "e:2", "p:1", 0.25), ("4", "e:1", "p:1", 0.0),
             ("5", "e:3", "c:missing", 1.0), ("6", "e:1", "e:2", 1.0), ("7", None, "e:1", 1.0)]
    got = {r.node: (r.degree, r.h1, r.h2) for r in M.neighbour_rounds(
        spark.createDataFrame(nodes, "id string, size double"),
        spark.createDataFrame(edges, "id string, source string, target string, weight double"), "size").collect()}
    x, links = dict(nodes), [(s, t, w or 0.5) for _, s, t, w in edges if s in dict(nodes) and t in dict(nodes)]
    for r in (0, 1):
        mean = {}
        for n in {n for s, t, _ in links for n in (s, t)}:
            near = [(w, x[t if s == n else s]) for s, t, w in links if n in (s, t)]
            mean[n] = sum(w * v for w, v in near) / sum(w for w, _ in near)
            assert abs(got[n][r + 1] - mean[n]) < 1e-8 and got[n][0] == len(near)
        x = mean
    assert set(got) == set(x)


def test_no_hub_is_a_shuffle_key(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        nodes = graph_nodes_df(spark, SF0001).select("id", "size")
        from petrograph.operators.graph import with_nodes
        plan = plan_text(with_nodes(graph_edges_df(spark, SF0001), "source", nodes, {"size": "x"}))
        assert "hashpartitioning(source#" not in plan
        last = plan_text(M.neighbour_rounds(nodes, graph_edges_df(spark, SF0001), "size", 1))
        # The messages are summed within each task before they are shuffled by node.
        assert "partial_sum" in last.split("hashpartitioning(node#")[-1]
    finally:
        spark.conf.set(key, old)


def test_explanation_walks_rows_in_batches(spark, fit):
    data, model, _ = fit
    blank = data.limit(50).withColumn("impact_sum", F.when(F.col("horizon") == "1h", F.lit(None)).otherwise(F.col("impact_sum")))
    got = M.explained(model.transform(blank), model)
    plan = plan_text(got)
    # Trees are data for the tasks: as expressions, each row evaluated 300 nested conditions and its factors one by one.
    assert "ArrowEvalPython" in plan and "lambda" not in plan and "CASE WHEN (cast(price" not in plan
    rows = got.collect()
    assert any(r.impact_sum is None for r in rows)
    assert all(abs(r.bias + sum(r.contributions.values()) - r.prediction) < 1e-9 for r in rows)
    assert [f.dataType.simpleString() for f in got.schema if f.name in ("contributions", "primary_factors")] == [
        "map<string,double>", "array<struct<factor:string,impact:double,confidence:double>>"]


def test_backtest_fits_its_folds_only(spark, fit, monkeypatch):
    monkeypatch.setattr(M, "_FITTED", {})
    fits, real = [], M.fit_gbt
    monkeypatch.setattr(M, "fit_gbt", lambda train: fits.append(1) or real(train))
    assert M.forecast_backtest(spark, SF001).count() == len(M.FOLD_STARTS) * len(M.HORIZON_SECONDS)
    assert len(fits) == len(M.FOLD_STARTS)
