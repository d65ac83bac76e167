"""Prediction pipeline.

The modelled application names graph neural networks and gradient-boosted
trees but contains no model.  What is built here is honest about that:

* M1 event features per price tick over the preceding horizon (trailing sums);
* M2 a fixed weighted neighbour mean over the graph in two rounds - a message
  passing *feature*, not a learned GNN;
* M3 ``pyspark.ml`` gradient-boosted trees on those features for the four horizons (the horizon
  is a feature), split by time and scored by rolling origin;
* M4 a trend rule, M5 the factors of every forecast by its paths through the trees, A8 forecast accuracy.

Realised and current prices are as-of lookups (``timeseries.asof``); no
range join or global window is used.  The test data has no true signal, so
model quality figures only show the pipeline runs.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrograph.functions import exprs as X
from petrograph.functions import sqltext as Q
from petrograph.operators.graph import effective_weight, graph_edges_df, graph_nodes_df, with_nodes
from petrograph.operators.sequences import neighbour
from petrograph.operators.timeseries import asof, trailing_sums
from petrograph.plans.registry import query
from petrograph.plans.storage import cut_lineage
from petrograph.sources.tables import table_path
from petrograph.sources.views import v_event, v_prediction, v_tick

HORIZON_SECONDS = {"1h": 3600, "6h": 6 * 3600, "24h": 24 * 3600, "7d": 7 * 86400}
FEATURE_HORIZON_S = 24 * 3600
TRAIN_SHARE = 0.7       # quantile of tick time at which testing begins
TREND_BAND = 0.005   # ours: predicted vs current beyond +-0.5%


def horizon_seconds(h) -> F.Column:
    out = None
    for k, s in HORIZON_SECONDS.items():
        out = F.when(h == k, s) if out is None else out.when(h == k, s)
    return out


def _horizon_interval_sql(h: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN INTERVAL {s} SECOND" for k, s in HORIZON_SECONDS.items())
    return f"(CASE {h} {arms} END)"


# -- M1 --------------------------------------------------------------------------------
def tick_features(spark: SparkSession, d: str) -> DataFrame:
    ticks = v_tick(spark, d)
    ev = v_event(spark, d).select("id", "ts", F.col("immediate").alias("impact"), "sentiment")
    f = trailing_sums(ticks, ev, point_id="id", point_ts="ts", event_ts="ts",
                      horizon_seconds=FEATURE_HORIZON_S, values=["impact", "sentiment"])
    return f.select("id", "ts", "price_type", "price", F.col("n_events").cast("long").alias("n_events"),
                    X.round_fixed("impact_sum", 9).alias("impact_sum"),
                    X.round_fixed("sentiment_sum", 9).alias("sentiment_sum"))


@query("price_event_features", "M1", sql=f"""
SELECT t.id, t.ts, t.price_type, t.price, count(e.id) AS n_events,
       {Q.round_fixed('sum(e.immediate)', 9)} AS impact_sum, {Q.round_fixed('sum(e.sentiment)', 9)} AS sentiment_sum
FROM v_tick t LEFT JOIN v_event e ON e.ts > t.ts - INTERVAL {FEATURE_HORIZON_S} SECOND AND e.ts <= t.ts
GROUP BY t.id, t.ts, t.price_type, t.price""")
def price_event_features(spark: SparkSession, d: str) -> DataFrame:
    """Per price tick: events, summed impact and sentiment in the preceding 24 h."""
    return tick_features(spark, d)


# -- M2 --------------------------------------------------------------------------------
def neighbour_rounds(nodes: DataFrame, edges: DataFrame, feature: str, rounds: int = 2) -> DataFrame:
    """node, degree, h1 .. h<rounds>: rounds of the undirected weighted neighbour mean sum(w * x) / sum(w).

    Round 1 averages ``feature`` over a node's neighbours, each further round the round before.  Only edges
    whose two endpoints are nodes carry messages.

    The graph is cut at its hubs: country and price nodes (26 by the view) are never a shuffle key.  As
    senders they are broadcast, and their edges go through the event join under keys of their own
    (``graph.with_nodes``); as receivers they are summed up within each task first, so their
    reducer gets a row per task.  A round's state, a row per node, is a table that the next one reads.
    """
    e = edges.select("id", "source", "target", effective_weight("weight").alias("w"))
    state, out = nodes.select("id", F.col(feature).alias("x")), None
    for r in range(1, rounds + 1):
        ends = with_nodes(with_nodes(e, "source", state, {"x": "xs"}), "target", state, {"x": "xt"})
        if r == 1:
            # Edges without two nodes are gone from here on.
            ends = cut_lineage(ends)
            e = ends.select("id", "source", "target", "w")
        sent = ends.select(F.inline(F.array(
            F.struct(F.col("target").alias("node"), "w", F.col("xs").alias("x")),
            F.struct(F.col("source").alias("node"), "w", F.col("xt").alias("x")))))
        mean = sent.groupBy("node").agg(F.count(F.lit(1)).alias("degree"),
                                        X.round_fixed(F.sum(F.col("w") * F.col("x")) / F.sum("w"), 9).alias(f"h{r}"))
        mean = cut_lineage(mean) if r < rounds else mean
        state = mean.select(F.col("node").alias("id"), F.col(f"h{r}").alias("x"))
        out = mean if out is None else out.join(mean.drop("degree"), "node")
    return out


_MESSAGES_SQL = """SELECT e.target AS node, e.w, s.{x} AS x FROM e JOIN {t} s ON s.{k} = e.source JOIN {t} d ON d.{k} = e.target
      UNION ALL SELECT e.source, e.w, d.{x} FROM e JOIN {t} s ON s.{k} = e.source JOIN {t} d ON d.{k} = e.target"""


@query("neighbour_aggregate", "M2", sql=f"""
WITH e AS (SELECT source, target, {Q.or_default('weight', 0.5)} AS w FROM g_edges),
m1 AS ({_MESSAGES_SQL.format(x='size', t='g_nodes', k='id')}),
h1 AS (SELECT node, count(*) AS degree, {Q.round_fixed('sum(w * x) / sum(w)', 9)} AS h1 FROM m1 GROUP BY node),
m2 AS ({_MESSAGES_SQL.format(x='h1', t='h1', k='node')}),
h2 AS (SELECT node, {Q.round_fixed('sum(w * x) / sum(w)', 9)} AS h2 FROM m2 GROUP BY node)
SELECT h1.node, degree, h1, h2 FROM h1 JOIN h2 USING (node)""")
def neighbour_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds of the weighted neighbour mean of node size (a fixed message-passing feature)."""
    return neighbour_rounds(graph_nodes_df(spark, d), graph_edges_df(spark, d), "size")


# -- current / realised prices -------------------------------------------------------------
def _wti(spark: SparkSession, d: str) -> DataFrame:
    return v_tick(spark, d).where(F.col("price_type") == "WTI").select("id", "ts", "price")


def predictions_with_prices(spark: SparkSession, d: str) -> DataFrame:
    p = v_prediction(spark, d).select("id", "ts", "horizon", F.col("price").alias("predicted"))
    wti = _wti(spark, d)
    cur = asof(p, wti, left_ts=F.col("ts"), right_ts="ts", right_order=["ts", "id"], values=["price"],
               prefix="current_")
    due = F.timestamp_add("SECOND", horizon_seconds(F.col("horizon")), F.col("ts"))
    return asof(cur, wti, left_ts=due, right_ts="ts", right_order=["ts", "id"], values=["price"],
                prefix="realised_")


def trend_rule(predicted, current) -> F.Column:
    return (F.when(current.isNull(), F.lit(None).cast("string"))
            .when(predicted > current * (1 + TREND_BAND), "bullish")
            .when(predicted < current * (1 - TREND_BAND), "bearish").otherwise("neutral"))


_PRICES_SQL = f"""
w AS (SELECT id, ts, price FROM v_tick WHERE price_type = 'WTI'),
p AS (SELECT id, ts, horizon, price AS predicted, ts + {_horizon_interval_sql('horizon')} AS due FROM v_prediction),
c AS (SELECT p.*, w.price AS current_price FROM p ASOF LEFT JOIN w ON p.ts >= w.ts),
r AS (SELECT c.*, w.price AS realised_price FROM c ASOF LEFT JOIN w ON c.due >= w.ts)"""


@query("forecast_trend", "M4", sql=f"""
WITH {_PRICES_SQL}
SELECT id, ts, horizon, predicted, current_price,
       CASE WHEN current_price IS NULL THEN NULL
            WHEN predicted > current_price * (1 + {TREND_BAND}) THEN 'bullish'
            WHEN predicted < current_price * (1 - {TREND_BAND}) THEN 'bearish' ELSE 'neutral' END AS trend
FROM c""")
def forecast_trend(spark: SparkSession, d: str) -> DataFrame:
    """bullish / bearish / neutral: predicted vs the latest WTI tick at prediction time."""
    p = v_prediction(spark, d).select("id", "ts", "horizon", F.col("price").alias("predicted"))
    cur = asof(p, _wti(spark, d), left_ts=F.col("ts"), right_ts="ts", right_order=["ts", "id"],
               values=["price"], prefix="current_")
    return cur.select("id", "ts", "horizon", "predicted", "current_price",
                      trend_rule(F.col("predicted"), F.col("current_price")).alias("trend"))


@query("forecast_accuracy", "A8", sql=f"""
WITH {_PRICES_SQL}
SELECT horizon, count(*) AS n,
       {Q.round_fixed('avg(abs(predicted - realised_price))', 6)} AS mae,
       {Q.round_fixed('sqrt(avg((predicted - realised_price) * (predicted - realised_price)))', 6)} AS rmse,
       {Q.round_fixed('avg(abs(predicted - realised_price) / realised_price) * 100', 6)} AS mape,
       {Q.round_fixed('avg(CASE WHEN sign(predicted - current_price) = sign(realised_price - current_price) THEN 1.0 ELSE 0.0 END)', 6)} AS hit_rate
FROM r WHERE current_price IS NOT NULL AND realised_price IS NOT NULL GROUP BY horizon""")
def forecast_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Per horizon: MAE, RMSE, MAPE and directional hit-rate of forecasts
    against the latest tick at or before ``ts + horizon``."""
    r = predictions_with_prices(spark, d).where(
        F.col("current_price").isNotNull() & F.col("realised_price").isNotNull())
    err = F.col("predicted") - F.col("realised_price")
    hit = F.when(F.signum(F.col("predicted") - F.col("current_price"))
                 == F.signum(F.col("realised_price") - F.col("current_price")), 1.0).otherwise(0.0)
    return r.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"),
        X.round_fixed(F.avg(F.abs(err)), 6).alias("mae"),
        X.round_fixed(F.sqrt(F.avg(err * err)), 6).alias("rmse"),
        X.round_fixed(F.avg(F.abs(err) / F.col("realised_price")) * 100, 6).alias("mape"),
        X.round_fixed(F.avg(hit), 6).alias("hit_rate"))


# -- M3 / M5 ---------------------------------------------------------------------------------
FEATURES = ["price", "prev_price", "n_events", "impact_sum", "sentiment_sum", "type_idx", "horizon_hours"]
#: Quantiles of tick time at which the folds' test periods begin; each ends where the next begins.
FOLD_STARTS = (0.5, 0.75)


def _at(ts: str = "ts") -> F.Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def labelled(features: DataFrame, ticks: DataFrame, horizons: dict[str, int] | None = None) -> DataFrame:
    """features once per horizon, with the same type's price that long after (``label``).

    All horizons are answered by one as-of pass: each tick asks once per horizon.  A label that lies
    beyond the type's last tick isn't known and NULL.
    """
    horizons = horizons or HORIZON_SECONDS
    asked = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(s).cast("long").alias("horizon_s"))
                                for h, s in horizons.items()])).alias("h")
    rows = features.select("*", asked).select(*features.columns, "h.horizon", "h.horizon_s")
    prices = ticks.select("id", "ts", "price_type", F.col("price").alias("label"))
    due = F.timestamp_add("SECOND", F.col("horizon_s").cast("int"), F.col("ts"))
    found = asof(rows, prices, left_ts=due, right_ts="ts", right_order=["ts", "id"], values=["label"],
                 keys=["price_type"], prefix="")
    # One row per price type, of which the view has three.
    ends = ticks.groupBy("price_type").agg(F.max("ts").alias("_end"))
    return (found.join(F.broadcast(ends), "price_type", "left")
            .withColumn("label", F.when(due <= F.col("_end"), F.col("label")))
            .withColumn("horizon_hours", F.col("horizon_s") / 3600.0).drop("_end"))


def training_frame(spark: SparkSession, d: str, horizons: dict[str, int] | None = None) -> DataFrame:
    """Features per tick and horizon, and the label."""
    f = neighbour(tick_features(spark, d), ["price_type"], ["ts", "id"], ["price"])
    f = f.withColumn("type_idx", F.when(F.col("price_type") == "WTI", 0.0)
                     .when(F.col("price_type") == "Brent", 1.0).otherwise(2.0))
    return labelled(f.na.fill(0.0, subset=["prev_price", "impact_sum", "sentiment_sum"]), v_tick(spark, d), horizons)


def before(data: DataFrame, cut_us: int) -> DataFrame:
    """Rows to train on: the label's own time, not only the tick's, lies before the cut."""
    return data.where((_at() + F.col("horizon_s") * 1_000_000 < F.lit(cut_us)) & F.col("label").isNotNull())


def fit_gbt(train: DataFrame, seed: int = 42):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    gbt = GBTRegressor(featuresCol="features", labelCol="label", maxIter=20, maxDepth=4, seed=seed)
    return Pipeline(stages=[assembler, gbt]).fit(train)


def quantiles_of_time(data: DataFrame, shares: list[float]) -> list[int]:
    """Times (microseconds) of the shares of ticks: one number each."""
    return data.agg(F.percentile_approx(_at(), shares).alias("q")).first()["q"] or []


#: (application, table, its files) -> training frame, and -> (training frame, model, cut): made once, read by M3 and M5.
_FRAMES: dict[tuple, DataFrame] = {}
_FITTED: dict[tuple, tuple] = {}


def _files(spark: SparkSession, d: str) -> tuple:
    """Names, sizes and times of the events table's files, so that another table isn't taken for it."""
    jvm, path = spark._jvm, table_path(d, "events")
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(place))


def frame(spark: SparkSession, d: str) -> DataFrame:
    """The training frame, saved once in the shared folder."""
    key = (spark.sparkContext.applicationId, _files(spark, d))
    if key not in _FRAMES:
        _FRAMES[key] = cut_lineage(training_frame(spark, d))
    return _FRAMES[key]


def fitted(spark: SparkSession, d: str):
    """(frame, model, cut): the saved features, and the model of the rows before the cut."""
    key = (spark.sparkContext.applicationId, _files(spark, d))
    if key not in _FITTED:
        data = frame(spark, d)
        cut = (quantiles_of_time(data, [TRAIN_SHARE]) or [0])[0]
        _FITTED[key] = (data, fit_gbt(before(data, cut)), cut)
    return _FITTED[key]


def requested(spark: SparkSession, d: str, horizon: str | None = None, include_explanation: bool = False) -> DataFrame:
    """A prediction request: forecasts of the ticks after the cut for one horizon (None: all four).

    With ``include_explanation`` each row also has bias, contributions (by feature) and ``primary_factors``.
    """
    if horizon is not None and horizon not in HORIZON_SECONDS:
        raise ValueError(f"horizon must be one of {', '.join(HORIZON_SECONDS)}")
    data, model, cut = fitted(spark, d)
    test = data.where(_at() >= F.lit(cut))
    test = test if horizon is None else test.where(F.col("horizon") == horizon)
    scored = model.transform(test)
    # confidence (ours): 1 - training MAPE of the horizon, in [0, 1]; a row per horizon, of which there are four.
    error = model.transform(before(data, cut)).groupBy("horizon").agg(
        F.avg(F.abs(F.col("prediction") - F.col("label")) / F.col("label")).alias("_mape"))
    out = (explained(scored, model) if include_explanation else scored).join(F.broadcast(error), "horizon", "left")
    extra = ["bias", "contributions", "primary_factors"] if include_explanation else []
    return out.select(F.concat(F.lit("gbt:"), F.col("id").cast("string"), F.lit(":"), "horizon").alias("id"), "ts", "horizon",
                      F.col("prediction").alias("price"),
                      F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce("_mape", F.lit(1.0)))).alias("confidence"),
                      trend_rule(F.col("prediction"), F.col("price")).alias("trend"), "price_type", *extra)


@query("forecast_train_score", "M3")
def forecast_train_score(spark: SparkSession, d: str) -> DataFrame:
    """Gradient-boosted trees trained on ticks before the cut, scored after it for all four horizons,
    as PredictionResult rows (time-ordered split, fixed seed)."""
    return requested(spark, d)


def rolling_origin(data: DataFrame, starts: tuple[float, ...] = FOLD_STARTS) -> DataFrame:
    """Errors by fold and horizon of expanding-window training.

    Each fold trains on labels known before its test period begins (an embargo of the horizon) and tests
    on ticks up to the next fold's beginning.  ``naive`` is the error of "the price stays".
    """
    cuts = quantiles_of_time(data, list(starts))
    out = None
    for i, cut in enumerate(cuts):
        until = cuts[i + 1] if i + 1 < len(cuts) else None
        test = data.where((_at() >= F.lit(cut)) & F.col("label").isNotNull())
        test = test if until is None else test.where(_at() < F.lit(until))
        train = before(data, cut)
        scored = fit_gbt(train).transform(test)
        err = F.col("prediction") - F.col("label")
        # A sign is hit where forecast and label lie on one side of the price.
        hit = (F.signum(F.col("prediction") - F.col("price")) == F.signum(F.col("label") - F.col("price"))).cast("double")
        fold = scored.groupBy("horizon").agg(
            F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
            F.avg(F.abs(F.col("price") - F.col("label"))).alias("naive_mae"), F.avg(hit).alias("hit_rate"))
        fold = fold.select(F.lit(i).alias("fold"), F.timestamp_micros(F.lit(cut)).cast("timestamp_ntz").alias("test_from"), "*")
        out = fold if out is None else out.unionByName(fold)
    return out


@query("forecast_backtest", "M3")
def forecast_backtest(spark: SparkSession, d: str) -> DataFrame:
    """Rolling-origin errors of the forecast by fold and horizon."""
    return rolling_origin(frame(spark, d))


# -- M5: tree paths --------------------------------------------------------------------------
def tree_paths(model) -> tuple[float, list[tuple]]:
    """(bias, a node table per tree): how the splits on a row's path change its forecast, by feature.

    The bias is the weighted mean of the roots.  What a split on feature f changes is the step from the
    node's mean to the child's; a tree's steps add up to its leaf, so bias and steps add up to the forecast.
    A table has each node's feature, threshold, left and right child (a leaf's are itself) and the steps on
    the path down to it, by feature.
    """
    import numpy as np

    gbt = model.stages[-1]
    bias, out = 0.0, []
    for tree, weight in zip(gbt.trees, gbt.treeWeights, strict=True):
        rows: list[list] = []

        def add(node, steps: list[float], rows: list = rows, weight: float = weight) -> int:
            me = len(rows)
            rows.append([0, 0.0, me, me, steps])
            if node.subtreeDepth():
                split, here = node.split(), node.prediction()
                f = split.featureIndex()
                rows[me][:2] = f, split.threshold()
                for side, child in ((2, node.leftChild()), (3, node.rightChild())):
                    below = list(steps)
                    below[f] += weight * (child.prediction() - here)
                    rows[me][side] = add(child, below)
            return me

        root = tree._call_java("rootNode")
        bias += weight * root.prediction()
        add(root, [0.0] * len(FEATURES))
        out.append((tree.depth, *map(np.array, zip(*rows, strict=True))))
    return bias, out


def path_factors(tables: list[tuple], names: list[str], top: int):
    """Column function of the features: struct of steps (by feature, added up over the trees) and primary_factors."""
    def factors(*features: pa.Array) -> pa.Array:
        import numpy as np

        # A missing feature is NaN, which is below no threshold.
        x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in features], axis=1)
        n, every = x.shape[0], np.arange(x.shape[0])
        total, up, down = np.zeros(x.shape), np.zeros(x.shape, int), np.zeros(x.shape, int)
        for depth, feature, at, left, right, steps in tables:
            node = np.zeros(n, int)
            for _ in range(depth):
                node = np.where(x[every, feature[node]] <= at[node], left[node], right[node])
            step = steps[node]
            total += step
            up += step > 0
            down += step < 0
        size = np.abs(total)
        whole = np.zeros(n)
        for own in size.T:
            whole += own
        # Largest first, ties by name.
        by_name = np.broadcast_to(np.argsort(np.argsort(names)), x.shape)
        chosen = np.lexsort((by_name, -size), axis=1)[:, :top]
        row, place = np.nonzero(np.take_along_axis(size, chosen, 1) > 0)
        f = chosen[row, place]
        own = total[row, f]
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
            [pa.array(names, pa.string()).take(pa.array(f)), pa.array(own / whole[row]),
             pa.array(np.where(own > 0, up[row, f], down[row, f]) / (up + down)[row, f])], ["factor", "impact", "confidence"]))
        starts = np.arange(n + 1, dtype=np.int32) * x.shape[1]
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(starts), pa.array(total.ravel())), listed],
                                          ["steps", "primary_factors"])

    return F.arrow_udf(factors, "steps array<double>, "
                                "primary_factors array<struct<factor: string, impact: double, confidence: double>>")


def explained(scored: DataFrame, model, top: int = 3) -> DataFrame:
    """scored plus bias, contributions (map of feature to price units) and primary_factors.

    A factor's impact is its share of all contributions' size, signed, so it lies in [-1, 1]; its confidence
    is the share of the trees that use it on this row and agree with that sign.  Batches of rows walk the
    trees' node tables together.
    """
    bias, tables = tree_paths(model)
    walked = scored.withColumn("_paths", path_factors(tables, FEATURES, top)(*[F.col(f).cast("double") for f in FEATURES]))
    return walked.select(*scored.columns, F.lit(bias).alias("bias"),
                         F.map_from_arrays(F.array(*map(F.lit, FEATURES)), "_paths.steps").alias("contributions"),
                         F.col("_paths.primary_factors").alias("primary_factors"))


@query("forecast_explanation", "M5")
def forecast_explanation(spark: SparkSession, d: str) -> DataFrame:
    """The primary factors of every scored row, largest first, from the paths it takes through the trees."""
    rows = requested(spark, d, include_explanation=True)
    return (rows.select("id", "ts", "horizon", "price", "bias", F.posexplode("primary_factors").alias("position", "f"))
            .select("id", "ts", "horizon", "price", "bias", (F.col("position") + 1).alias("position"), "f.factor", "f.impact",
                    "f.confidence"))
