"""Data-quality checks over the declared types (Q1-Q3): rules as data, one scan per table.

``entities_of_events`` puts everything that a row of the events table stands for - the event, its edges,
the tick or the prediction - into one array of (entity, id, fields).  A rule names an entity, a field
and what is bad about it; all rules are answered by one aggregate over one scan (``checked``), and the same
scan gives the offending rows with the names of the rules they break (``offenders``), which ``quarantine``
writes to a table of their own.

NULL values are not checked, and break no rule.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from petrograph import schemas as S
from petrograph.plans.registry import query
from petrograph.plans.storage import scratch_path
from petrograph.sources import views as V
from petrograph.sources.tables import read_table


@dataclass(frozen=True)
class Rule:
    """A field of an entity with a closed range or a list of values."""

    name: str
    entity: str
    field: str
    low: float | None = None
    high: float | None = None
    values: tuple[str, ...] = ()

    def bad(self, value: Column) -> Column:
        return ~value.isin(*self.values) if self.values else ~value.between(self.low, self.high)


RANGES = (Rule("sentiment", "event", "sentiment", -1, 1), Rule("edge_weight", "edge", "weight", 0, 1),
          Rule("confidence", "prediction", "confidence", 0, 1), Rule("factor_impact", "factor", "impact", -1, 1))
DOMAINS = (Rule("event_type", "event", "event_type", values=S.EVENT_TYPES), Rule("severity", "event", "severity", values=S.SEVERITIES),
           Rule("price_type", "price", "price_type", values=S.PRICE_TYPES),
           Rule("tick_price_type", "tick", "price_type", values=S.PRICE_TYPES),
           Rule("node_type", "node", "type", values=S.NODE_TYPES), Rule("edge_type", "edge", "type", values=S.EDGE_TYPES),
           Rule("horizon", "prediction", "horizon", values=S.HORIZONS), Rule("trend", "prediction", "trend", values=S.TRENDS))

#: Fields that rules look at, with one type each.
_NUMBERS, _TEXTS = ("sentiment", "weight", "confidence", "impact"), ("event_type", "severity", "price_type", "type", "horizon", "trend")


def _entity(name: str, key: Column, fields: dict[str, Column]) -> Column:
    return F.struct(F.lit(name).alias("entity"), key.cast("string").alias("id"),
                    *[fields.get(c, F.lit(None)).cast("double").alias(c) for c in _NUMBERS],
                    *[fields.get(c, F.lit(None)).cast("string").alias(c) for c in _TEXTS])


def entities_of_events(e: DataFrame) -> DataFrame:
    """entities: array of what each row of the events table stands for."""
    ev = e.select("*", F.struct(*V.event_columns()).alias("_ev"), F.when(V.is_prediction(), F.struct(*V.prediction_columns(True))).alias("_pr"),
                  F.when(V.is_tick(), F.struct(*V.tick_columns())).alias("_ti"))
    names = ("id", "source", "target", "weight", "type")
    edge = lambda columns: F.struct(*[c.alias(n) for c, n in zip(columns, names, strict=True)])
    country_edges = F.transform("_ev.countries", lambda c, i: edge(V.country_edge_columns(F.col("_ev.id"), i, c)))
    price_edges = F.filter(F.array(edge(V.price_edge_columns(F.col("_ev.id"), F.col("_ev.immediate")))),
                           lambda x: x["weight"].isNotNull())
    node = F.concat(F.lit("e:"), F.col("_ev.id").cast("string"))
    one = lambda row, made: F.filter(F.array(made), lambda x: F.col(row).isNotNull())
    return ev.select(F.concat(
        F.array(_entity("event", F.col("_ev.id"), {c: F.col(f"_ev.{c}") for c in ("sentiment", "event_type", "severity")}),
                _entity("node", node, {"type": F.lit("event")})),
        F.transform(F.concat(country_edges, price_edges), lambda x: _entity("edge", x["id"], {"weight": x["weight"], "type": x["type"]})),
        one("_pr", _entity("prediction", F.col("_pr.id"), {c: F.col(f"_pr.{c}") for c in ("confidence", "horizon", "trend")})),
        F.transform(F.coalesce("_pr.primary_factors", F.array().cast("array<struct<factor:string,impact:double,confidence:double>>")),
                    lambda f: _entity("factor", F.concat_ws(":", F.col("_pr.id"), f["factor"]), {"impact": f["impact"]})),
        one("_ti", _entity("tick", F.col("_ti.id"), {"price_type": F.col("_ti.price_type")}))).alias("entities"))


def entity_rows(spark: SparkSession, d: str, rules: tuple[Rule, ...]) -> DataFrame:
    """entity, id and fields of everything that the rules look at: each table is scanned once."""
    wanted = {r.entity for r in rules}
    e = read_table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    parts = [entities_of_events(e).select(F.inline(F.filter("entities", lambda x: x["entity"].isin(*wanted))))]
    if "price" in wanted:
        parts.append(V.v_price(spark, d).select(F.inline(F.array(_entity("price", F.col("id"), {"price_type": F.col("price_type")})))))
    if "node" in wanted:
        nodes = V.country_dim(spark, d).select(F.concat(F.lit("c:"), "id").alias("id"), F.lit("country").alias("type")) \
            .unionByName(spark.range(1).select(F.lit(S.PRICE_NODE_ID).alias("id"), F.lit("price_point").alias("type")))
        parts.append(nodes.select(F.inline(F.array(_entity("node", F.col("id"), {"type": F.col("type")})))))
    return reduce(DataFrame.unionByName, parts)


def checked(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """check, n_checked, n_violations of all rules by one aggregate."""
    aggs = []
    for i, r in enumerate(rules):
        mine = F.col("entity") == r.entity
        aggs += [F.count_if(mine & F.col(r.field).isNotNull()).alias(f"_c{i}"),
                 F.count_if(mine & F.coalesce(r.bad(F.col(r.field)), F.lit(False))).alias(f"_v{i}")]
    told = F.array(*[F.struct(F.lit(r.name).alias("check"), F.col(f"_c{i}").alias("n_checked"), F.col(f"_v{i}").alias("n_violations"))
                     for i, r in enumerate(rules)])
    return rows.agg(*aggs).select(F.inline(told))


def offenders(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """entity, id, rules of the rows that break any."""
    broken = [F.when((F.col("entity") == r.entity) & r.bad(F.col(r.field)), F.lit(r.name)) for r in rules]
    return (rows.select("entity", "id", F.filter(F.array(*broken), lambda x: x.isNotNull()).alias("rules"))
            .where(F.size("rules") > 0))


def quarantine(rows: DataFrame, rules: tuple[Rule, ...], path: str) -> DataFrame:
    """The offending rows, written to a table of their own."""
    offenders(rows, rules).write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


@query("dq_ranges", "Q1", sql="""
SELECT 'sentiment' AS "check", count(sentiment) AS n_checked,
       count(*) FILTER (WHERE sentiment NOT BETWEEN -1 AND 1) AS n_violations FROM v_event
UNION ALL SELECT 'edge_weight', count(weight), count(*) FILTER (WHERE weight NOT BETWEEN 0 AND 1) FROM g_edges
UNION ALL SELECT 'confidence', count(confidence), count(*) FILTER (WHERE confidence NOT BETWEEN 0 AND 1)
  FROM v_prediction
UNION ALL SELECT 'factor_impact', count(f.impact), count(*) FILTER (WHERE f.impact NOT BETWEEN -1 AND 1)
  FROM (SELECT unnest(primary_factors) AS f FROM v_prediction) x""")
def dq_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Documented ranges: sentiment -1..1, weight 0..1, confidence 0..1, factor impact -1..1."""
    return checked(entity_rows(spark, d, RANGES), RANGES)


def _domain_sql(name: str, col: str, view: str, values: tuple[str, ...]) -> str:
    vals = ", ".join(f"'{v}'" for v in values)
    return (f"SELECT '{name}' AS \"check\", count({col}) AS n_checked, "
            f"count(*) FILTER (WHERE {col} NOT IN ({vals})) AS n_violations FROM {view}")


_DOMAINS = [
    ("event_type", "event_type", "v_event", S.EVENT_TYPES),
    ("severity", "severity", "v_event", S.SEVERITIES),
    ("price_type", "price_type", "v_price", S.PRICE_TYPES),
    ("tick_price_type", "price_type", "v_tick", S.PRICE_TYPES),
    ("node_type", "type", "g_nodes", S.NODE_TYPES),
    ("edge_type", "type", "g_edges", S.EDGE_TYPES),
    ("horizon", "horizon", "v_prediction", S.HORIZONS),
    ("trend", "trend", "v_prediction", S.TRENDS),
]


@query("dq_domains", "Q2", sql="\nUNION ALL\n".join(_domain_sql(*x) for x in _DOMAINS))
def dq_domains(spark: SparkSession, d: str) -> DataFrame:
    """Enum-domain violations per column (``isin`` on the declared values)."""
    return checked(entity_rows(spark, d, DOMAINS), DOMAINS)


@query("dq_quarantine", "Q1 Q2", sql="""
SELECT 'event' AS entity, CAST(id AS VARCHAR) AS id, 'sentiment' AS rules FROM v_event WHERE sentiment NOT BETWEEN -0.9 AND 1
UNION ALL SELECT 'edge', id, 'edge_weight' FROM g_edges WHERE weight NOT BETWEEN 0 AND 0.95
UNION ALL SELECT 'prediction', CAST(id AS VARCHAR), 'confidence' FROM v_prediction WHERE confidence NOT BETWEEN 0.001 AND 1""")
def dq_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Rows that break rules tighter than the declared ranges (as a feed's owner might set them), kept apart."""
    rules = (Rule("sentiment", "event", "sentiment", -0.9, 1), Rule("edge_weight", "edge", "weight", 0, 0.95),
             Rule("confidence", "prediction", "confidence", 0.001, 1))
    kept = quarantine(entity_rows(spark, d, rules), rules, scratch_path(spark, "quarantine"))
    return kept.withColumn("rules", F.array_join("rules", ","))


@query("dq_orphan_refs", "Q3", sql="""
SELECT x.id, x.pos, x.country_id FROM (
  SELECT id, unnest(countries) AS country_id, generate_subscripts(countries, 1) - 1 AS pos FROM v_event) x
WHERE NOT EXISTS (SELECT 1 FROM v_country c WHERE c.id = x.country_id)""")
def dq_orphan_refs(spark: SparkSession, d: str) -> DataFrame:
    """``events.countries[]`` ids with no country (shown raw by the report)."""
    ex = V.v_event(spark, d).select("id", F.posexplode("countries").alias("pos", "country_id"))
    dim = F.broadcast(V.country_dim(spark, d).select(F.col("id").alias("country_id")))
    return ex.join(dim, "country_id", "left_anti").select("id", F.col("pos").cast("long").alias("pos"),
                                                         "country_id")
