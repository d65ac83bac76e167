"""Typed country-event-price graph as node and edge tables, and the
questions asked of it (G1-G13, J2-J4, A3, A4).

Nodes are one flat table (variant fields nullable) keyed by prefixed ids
('c:', 'e:', 'p:') because raw ids are only unique per kind.  All graph work
is one hop of joins or aggregations; every event links to the single price
node, so anything keyed on an endpoint aggregates with map-side partial
aggregation (a few rows per task reach the hub's reducer) or joins with AQE
skew splitting enabled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from petrograph import schemas as S
from petrograph.functions import exprs as X
from petrograph.functions import sqltext as Q
from petrograph.operators.ordering import extreme_row
from petrograph.operators.sequences import ordinal_index
from petrograph.plans.registry import query
from petrograph.sources.views import (country_dim, v_country, v_country_event_edge, v_event,
                                      v_event_price_edge, v_tick)

NODE_COLS = ["id", "label", "type", "size", "colour", "code", "oil_production", "severity", "immediate", "price"]
EDGE_COLS = ["id", "source", "target", "weight", "type"]


# -- nodes ---------------------------------------------------------------------------
def country_nodes(spark: SparkSession, d: str) -> DataFrame:
    return country_nodes_of(v_country(spark, d))


def country_nodes_of(c: DataFrame) -> DataFrame:
    """Countries (id, name, code, oil_production) -> country nodes."""
    return c.select(F.concat(F.lit("c:"), "id").alias("id"), F.col("name").alias("label"),
                    F.lit("country").alias("type"),
                    (F.lit(S.COUNTRY_NODE_BASE_SIZE) + X.or_zero("oil_production") / 1e6).alias("size"),
                    F.lit(S.COUNTRY_NODE_COLOUR).alias("colour"), "code", "oil_production")


def event_nodes(spark: SparkSession, d: str) -> DataFrame:
    return event_nodes_of(v_event(spark, d))


def event_nodes_of(e: DataFrame) -> DataFrame:
    """Events (id, title, severity, immediate) -> event nodes; no impact -> size 15."""
    return e.select(F.concat(F.lit("e:"), F.col("id").cast("string")).alias("id"),
                    X.label_prefix("title").alias("label"), F.lit("event").alias("type"),
                    (F.lit(S.EVENT_NODE_BASE_SIZE)
                     + F.coalesce(F.col("immediate") * S.EVENT_NODE_IMPACT_SCALE, F.lit(0.0))).alias("size"),
                    X.event_node_colour("severity").alias("colour"), "severity", "immediate")


def price_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The current-price node: the latest WTI tick (a global ``max_by``)."""
    return price_node_of(v_tick(spark, d).where(F.col("price_type") == "WTI"))


def price_node_of(t: DataFrame) -> DataFrame:
    """Ticks (id, ts, price) -> the single current-price node."""
    return extreme_row(t, [], ["ts", "id"], ["price"], alias="_p").select(
        F.lit(S.PRICE_NODE_ID).alias("id"), F.lit(S.PRICE_NODE_LABEL).alias("label"),
        F.lit("price_point").alias("type"), F.lit(S.PRICE_NODE_SIZE).alias("size"),
        F.lit(S.PRICE_NODE_COLOUR).alias("colour"), F.col("_p.price").alias("price"))


def graph_nodes_df(spark: SparkSession, d: str) -> DataFrame:
    return nodes_of(country_nodes(spark, d), event_nodes(spark, d), price_nodes(spark, d))


def graph_node_keys(spark: SparkSession, d: str) -> DataFrame:
    """Node table for questions about ids, types and labels only.

    Country nodes come from the 25-row nation dimension, so these queries
    never scan ``lineitem`` (the largest table) for production figures they
    do not read: a left join to an aggregate is not removed by the optimizer
    even when none of its columns is used.  Country size and production are
    NULL here; every other column is as in ``graph_nodes_df``.
    """
    countries = country_dim(spark, d).select(
        F.concat(F.lit("c:"), "id").alias("id"), F.col("name").alias("label"),
        F.lit("country").alias("type"), F.lit(None).cast("double").alias("size"),
        F.lit(S.COUNTRY_NODE_COLOUR).alias("colour"), "code", F.lit(None).cast("double").alias("oil_production"))
    return nodes_of(countries, event_nodes(spark, d), price_nodes(spark, d))


def nodes_of(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(*NODE_COLS)


def graph_edges_df(spark: SparkSession, d: str) -> DataFrame:
    return v_country_event_edge(spark, d).select(*EDGE_COLS).unionByName(
        v_event_price_edge(spark, d).select(*EDGE_COLS))


@query("country_nodes", "G1", sql="SELECT id, label, type, size, colour, code, oil_production FROM g_nodes "
                                  "WHERE type = 'country'")
def q_country_nodes(spark: SparkSession, d: str) -> DataFrame:
    return country_nodes(spark, d)


@query("event_nodes", "G2", sql="SELECT id, label, type, size, colour, severity, immediate FROM g_nodes "
                                "WHERE type = 'event'")
def q_event_nodes(spark: SparkSession, d: str) -> DataFrame:
    return event_nodes(spark, d)


@query("price_nodes", "G3", sql="SELECT id, label, type, size, colour, price FROM g_nodes "
                                "WHERE type = 'price_point'")
def q_price_nodes(spark: SparkSession, d: str) -> DataFrame:
    return price_nodes(spark, d)


@query("graph_nodes", "G4 U1", sql="SELECT * FROM g_nodes")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph_nodes_df(spark, d)


def type_rank(t: Column) -> Column:
    return F.when(t == "country", 0).when(t == "event", 1).otherwise(2)


@query("node_ordinals", "G5", sql="""
SELECT id, type, row_number() OVER (ORDER BY CASE type WHEN 'country' THEN 0 WHEN 'event' THEN 1 ELSE 2 END, id) - 1
       AS ordinal
FROM g_nodes""")
def node_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """0-based position in (kind, id) order, computed without a global window."""
    n = graph_node_keys(spark, d).select("id", "type").withColumn("_r", type_rank(F.col("type")))
    return ordinal_index(n, [F.col("_r"), F.col("id")]).select("id", "type", "ordinal")


# -- edges ---------------------------------------------------------------------------
@query("country_event_edges", "G6", sql=f"""
SELECT id, source, target, weight, type, 1 + weight * 3 AS width, {Q.strength_band('weight')} AS band
FROM v_country_event_edge""")
def country_event_edges(spark: SparkSession, d: str) -> DataFrame:
    e = v_country_event_edge(spark, d)
    return e.select(*EDGE_COLS, (1 + F.col("weight") * 3).alias("width"), X.strength_band("weight").alias("band"))


@query("event_price_edges", "G7", sql="""
SELECT id, source, target, weight, type, 1 + weight * 2 AS width FROM v_event_price_edge""")
def event_price_edges(spark: SparkSession, d: str) -> DataFrame:
    return v_event_price_edge(spark, d).select(*EDGE_COLS, (1 + F.col("weight") * 2).alias("width"))


@query("graph_edges", "G8 U1", sql="SELECT * FROM g_edges")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph_edges_df(spark, d)


@query("graph_elements", "G9 U1", sql="""
SELECT 'node' AS element, id, coalesce(label, '') AS label, type, NULL AS source, NULL AS target,
       CAST(NULL AS DOUBLE) AS weight, size, code, severity, immediate, price FROM g_nodes
UNION ALL
SELECT 'edge', id, '', type, source, target, weight, NULL, NULL, NULL, NULL, NULL FROM g_edges""")
def graph_elements(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges in one element list; payload fields that would clash
    with id/label/type are dropped, a missing label becomes ''."""
    return elements_of(graph_nodes_df(spark, d), graph_edges_df(spark, d))


def elements_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    listed = nodes.select(
        F.lit("node").alias("element"), "id", F.coalesce("label", F.lit("")).alias("label"), "type",
        "size", "code", "severity", "immediate", "price")
    links = edges.select(
        F.lit("edge").alias("element"), "id", F.lit("").alias("label"), "type", "source", "target", "weight")
    return listed.unionByName(links, allowMissingColumns=True)


def effective_weight(w) -> Column:
    """``weight || 0.5``: missing, NaN or 0 becomes 0.5."""
    return X.or_default(w, S.DEFAULT_EDGE_WEIGHT)


@query("edge_effective_weight", "G11", sql=f"""
SELECT id, weight, {Q.or_default('weight', 0.5)} AS eff_weight,
       greatest(1.0, {Q.or_default('weight', 0.5)} * 2.0 * 3) AS width,
       {Q.strength_band(Q.or_default('weight', 0.5))} AS band
FROM g_edges""")
def edge_effective_weight(spark: SparkSession, d: str, edge_width: float = S.DEFAULT_EDGE_WIDTH_SETTING) -> DataFrame:
    w = effective_weight("weight")
    return graph_edges_df(spark, d).select(
        "id", "weight", w.alias("eff_weight"),
        F.greatest(F.lit(1.0), w * F.lit(edge_width) * 3).alias("width"), X.strength_band(w).alias("band"))


# -- endpoint joins ----------------------------------------------------------------------
#: Id prefixes of the kinds with few nodes: the country dimension (25 rows by its definition) and the one
#: price node.  Their edges may be any share of all edges; events are many, and no event is a hub.
FEW = ("c:", "p:")
FEW_TYPES = ("country", "price_point")


def is_few(c: Column) -> Column:
    """Whether a prefixed node id is of a kind with few nodes (NULL: no)."""
    return F.coalesce(reduce(lambda a, b: a | b, [c.startswith(p) for p in FEW]), F.lit(False))


def event_end(end: str) -> Column:
    """Join key of an edge's endpoint: possible hubs are replaced by a value of the edge's own that no node
    has, so that they spread over all tasks."""
    return F.when(is_few(F.col(end)), F.concat(F.lit("~"), "id")).otherwise(F.col(end))


def _member(edges: DataFrame, end: str, node_ids: DataFrame, few: bool, many: bool, out: str) -> DataFrame:
    """Add ``out``: is the endpoint among the ids?  Repeated ids don't multiply edges."""
    ids, hit = node_ids.select("id"), F.lit(False)
    if few:
        side = ids.where(is_few(F.col("id"))) if many else ids
        side = F.broadcast(side.distinct().select(F.col("id").alias("_few")))
        edges, hit = edges.join(side, edges[end] == F.col("_few"), "left"), hit | F.col("_few").isNotNull()
    if many:
        side = ids.where(~is_few(F.col("id"))).distinct().select(F.col("id").alias("_many"))
        edges, hit = edges.join(side, event_end(end) == F.col("_many"), "left"), hit | F.col("_many").isNotNull()
    return edges.withColumn(out, hit).drop("_few", "_many")


def endpoint_flags(edges: DataFrame, node_ids: DataFrame, few: bool = True, many: bool = True) -> DataFrame:
    """Add ``src_hit`` / ``dst_hit``: is the endpoint in ``node_ids``?

    ``few`` / ``many``: whether ``node_ids`` may hold country and price nodes / events.  The few are
    broadcast; the shuffled join is on event ids only, where no key is a hub.
    """
    both = _member(edges, "source", node_ids, few, many, "src_hit")
    return _member(both, "target", node_ids, few, many, "dst_hit")


def with_nodes(edges: DataFrame, end: str, nodes: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Edges with the columns (name -> new name) of the node at ``end``; edges without one go.  Hubs as above."""
    few = nodes.where(is_few(F.col("id"))).select(F.col("id").alias("_few"), *(F.col(c).alias(f"_f_{c}") for c in columns))
    many = nodes.where(~is_few(F.col("id"))).select(F.col("id").alias("_many"), *(F.col(c).alias(f"_m_{c}") for c in columns))
    j = (edges.join(F.broadcast(few), edges[end] == F.col("_few"), "left")
         .join(many, event_end(end) == F.col("_many"), "left")
         .where(F.col("_few").isNotNull() | F.col("_many").isNotNull()))
    return j.select(*edges.columns, *(F.when(F.col("_few").isNotNull(), F.col(f"_f_{c}")).otherwise(F.col(f"_m_{c}"))
                                      .alias(n) for c, n in columns.items()))


@query("edges_with_endpoints", "J2", sql="""
SELECT e.id, e.source, e.target, e.weight, s.type AS source_type, s.label AS source_label,
       t.type AS target_type, t.label AS target_label
FROM g_edges e JOIN g_nodes s ON e.source = s.id JOIN g_nodes t ON e.target = t.id""")
def edges_with_endpoints(spark: SparkSession, d: str) -> DataFrame:
    nodes = graph_node_keys(spark, d).select("id", "type", "label")
    e = graph_edges_df(spark, d).select("id", "source", "target", "weight")
    e = with_nodes(e, "source", nodes, {"type": "source_type", "label": "source_label"})
    return with_nodes(e, "target", nodes, {"type": "target_type", "label": "target_label"})


@query("dangling_edges", "J3", sql="""
SELECT e.id, e.source, e.target, s.id IS NULL AS missing_source, t.id IS NULL AS missing_target
FROM g_edges e LEFT JOIN g_nodes s ON e.source = s.id LEFT JOIN g_nodes t ON e.target = t.id
WHERE s.id IS NULL OR t.id IS NULL""")
def dangling_edges(spark: SparkSession, d: str) -> DataFrame:
    f = endpoint_flags(graph_edges_df(spark, d), graph_node_keys(spark, d))
    return (f.where(~F.col("src_hit") | ~F.col("dst_hit"))
            .select("id", "source", "target", (~F.col("src_hit")).alias("missing_source"),
                    (~F.col("dst_hit")).alias("missing_target")))


def incident_edges(spark: SparkSession, d: str, node_type: str) -> DataFrame:
    return incident_edges_of(graph_node_keys(spark, d), graph_edges_df(spark, d), node_type)


def incident_edges_of(nodes: DataFrame, edges: DataFrame, node_type: str) -> DataFrame:
    """Edges with at least one endpoint among the nodes of ``node_type``."""
    few = node_type in FEW_TYPES
    f = endpoint_flags(edges, nodes.where(F.col("type") == node_type).select("id"), few, not few)
    return f.where(F.col("src_hit") | F.col("dst_hit")).select(*EDGE_COLS)


_INCIDENT_SQL = """
SELECT e.* FROM g_edges e
WHERE EXISTS (SELECT 1 FROM g_nodes n WHERE n.type = '{t}' AND n.id = e.source)
   OR EXISTS (SELECT 1 FROM g_nodes n WHERE n.type = '{t}' AND n.id = e.target)"""


@query("incident_edges_by_node_type", "J4", sql=_INCIDENT_SQL.format(t="country"))
def incident_edges_by_node_type(spark: SparkSession, d: str, node_type: str = "country") -> DataFrame:
    return incident_edges(spark, d, node_type)


@query("subgraph_by_node_type", "G12", sql=f"""
SELECT 'node' AS element, id FROM g_nodes WHERE type = 'country'
UNION ALL
SELECT 'edge', id FROM ({_INCIDENT_SQL.format(t='country')}) x""")
def subgraph_by_node_type(spark: SparkSession, d: str, node_type: str = "country") -> DataFrame:
    """'all' keeps everything; otherwise nodes of the type and every incident edge."""
    return subgraph_of(graph_node_keys(spark, d), graph_edges_df(spark, d), node_type)


def subgraph_of(nodes: DataFrame, edges: DataFrame, node_type: str) -> DataFrame:
    if node_type == "all":
        return (nodes.select(F.lit("node").alias("element"), "id")
                .unionByName(edges.select(F.lit("edge").alias("element"), "id")))
    return (nodes.where(F.col("type") == node_type).select(F.lit("node").alias("element"), "id")
            .unionByName(incident_edges_of(nodes, edges, node_type).select(F.lit("edge").alias("element"), "id")))


@query("node_incident_edges", "G13", sql="""
SELECT node, count(*) AS n_edges, sum(weight) AS weight_sum FROM (
  SELECT id, source AS node, weight FROM g_edges
  UNION ALL SELECT id, target, weight FROM g_edges WHERE target <> source) x
GROUP BY node""")
def node_incident_edges(spark: SparkSession, d: str) -> DataFrame:
    """Per node: number and total weight of touching edges (self-loops once).

    Partial aggregation before the shuffle keeps the hub price node cheap.
    """
    return incident_counts(graph_edges_df(spark, d))


def incident_counts(e: DataFrame) -> DataFrame:
    ends = e.select("weight", F.explode(F.array_distinct(F.array("source", "target"))).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("n_edges"),
                                    X.round_fixed(F.sum("weight"), 9).alias("weight_sum"))


@query("graph_stats", "A3", sql=f"""
SELECT (SELECT count(*) FROM g_nodes) AS n_nodes, (SELECT count(*) FROM g_edges) AS n_edges,
       (SELECT {Q.round_fixed('avg(weight)', 9)} FROM g_edges) AS avg_weight,
       (SELECT count(*) FROM g_nodes WHERE severity IN ('critical', 'high')) AS high_impact_events""")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    """Node / edge counts, mean weight and high-impact events, computed.

    One-row aggregates are combined by a union and a final aggregate rather
    than a cross join.
    """
    return graph_stats_of(graph_node_keys(spark, d), graph_edges_df(spark, d))


def graph_stats_of(nodes_df: DataFrame, edges_df: DataFrame) -> DataFrame:
    nodes = nodes_df.agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.count_if(F.col("severity").isin("critical", "high")).alias("high_impact_events"))
    edges = edges_df.agg(F.count(F.lit(1)).alias("n_edges"),
                                         F.sum("weight").alias("_wsum"), F.count("weight").alias("_wn"))
    both = nodes.unionByName(edges, allowMissingColumns=True)
    return both.agg(F.max("n_nodes").alias("n_nodes"), F.max("n_edges").alias("n_edges"),
                    X.round_fixed(F.max("_wsum") / F.max("_wn"), 9).alias("avg_weight"),
                    F.max("high_impact_events").alias("high_impact_events"))


@query("edge_strength_histogram", "A4", sql=f"""
SELECT band, count(*) AS n_edges, {Q.round_fixed('avg(w)', 9)} AS avg_weight, min(w) AS min_weight,
       max(w) AS max_weight
FROM (SELECT {Q.or_default('weight', 0.5)} AS w, {Q.strength_band(Q.or_default('weight', 0.5))} AS band
      FROM g_edges) x GROUP BY band""")
def edge_strength_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Bands on the effective weight with the code's strict cut-offs."""
    return strength_histogram(graph_edges_df(spark, d))


def strength_histogram(edges: DataFrame) -> DataFrame:
    w = effective_weight("weight")
    e = edges.select(w.alias("w"), X.strength_band(w).alias("band"))
    return e.groupBy("band").agg(F.count(F.lit(1)).alias("n_edges"),
                                 X.round_fixed(F.avg("w"), 9).alias("avg_weight"),
                                 F.min("w").alias("min_weight"), F.max("w").alias("max_weight"))
