"""DuckDB definitions of the domain views, prepended as CTEs to oracle SQL.

They repeat ``petrograph.sources.views`` in DuckDB's dialect so that the
driver's oracle can run every query on the raw parquet tables.
"""

from __future__ import annotations

import re

from petrograph.functions import sqltext as Q

_COUNTRY_IDS = ("list_slice(['NATION_' || CAST(user_id % 25 AS VARCHAR), "
                "'NATION_' || CAST((user_id + 5) % 25 AS VARCHAR), "
                "'NATION_' || CAST((user_id + 12) % 27 AS VARCHAR)], 1, CAST(1 + event_id % 3 AS INTEGER))")

_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

VIEWS: dict[str, str] = {
    "v_country": f"""
SELECT n.n_name AS id, n.n_name AS name, 'N' || lpad(CAST(n.n_nationkey AS VARCHAR), 2, '0') AS code,
       r.r_name AS region, p.oil_production, c.oil_reserves
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT s_nationkey AS k, sum(l_quantity) AS oil_production
           FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey) p ON p.k = n.n_nationkey
LEFT JOIN (SELECT c_nationkey AS k, {Q.round_fixed('sum(c_acctbal)', 2)} AS oil_reserves
           FROM customer GROUP BY c_nationkey) c ON c.k = n.n_nationkey""",
    "v_event": f"""
SELECT event_id AS id, ts, event_type || ' event #' || CAST(event_id AS VARCHAR) AS title,
       CASE event_type WHEN 'error' THEN 'conflict' WHEN 'click' THEN 'trade' WHEN 'view' THEN 'political'
                       WHEN 'signup' THEN 'economic' ELSE 'sanction' END AS event_type,
       CASE WHEN value >= 200 THEN 'critical' WHEN value >= 100 THEN 'high' WHEN value >= 40 THEN 'medium'
            ELSE 'low' END AS severity,
       1.0::DOUBLE - 2 * value / 500 AS sentiment,
       CASE WHEN event_type = 'view' THEN NULL ELSE value / 500 END AS immediate,
       {_COUNTRY_IDS} AS countries
FROM events""",
    "v_price": """
SELECT o_orderkey AS id, o_orderdate AS ts, o_totalprice / 5000 AS price,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'WTI' WHEN o_orderpriority = '3-MEDIUM' THEN 'Brent'
            ELSE 'Dubai' END AS price_type
FROM orders""",
    "v_tick": """
SELECT event_id AS id, ts, 50 + value / 10 AS price,
       CASE user_id % 3 WHEN 0 THEN 'WTI' WHEN 1 THEN 'Brent' ELSE 'Dubai' END AS price_type
FROM events WHERE event_type = 'signup'""",
    "v_prediction": f"""
SELECT event_id AS id, ts,
       CASE event_id % 4 WHEN 0 THEN '1h' WHEN 1 THEN '6h' WHEN 2 THEN '24h' ELSE '7d' END AS horizon,
       value AS price, value / 500 AS confidence,
       CASE WHEN value >= 100 THEN 'bullish' WHEN value < 20 THEN 'bearish' ELSE 'neutral' END AS trend,
       {_K} AS k,
       [{{'factor': 'f0', 'impact': ({_K} * 3) % 100 / 100.0::DOUBLE, 'confidence': ({_K} + 0) % 100 / 100.0::DOUBLE}},
        {{'factor': 'f1', 'impact': ({_K} * 4) % 100 / 100.0::DOUBLE, 'confidence': ({_K} + 7) % 100 / 100.0::DOUBLE}},
        {{'factor': 'f2', 'impact': ({_K} * 5) % 100 / 100.0::DOUBLE, 'confidence': ({_K} + 14) % 100 / 100.0::DOUBLE}},
        {{'factor': 'f3', 'impact': ({_K} * 6) % 100 / 100.0::DOUBLE, 'confidence': ({_K} + 21) % 100 / 100.0::DOUBLE}}]
         AS primary_factors,
       [CAST(event_id - 1 AS VARCHAR), CAST(event_id + 1 AS VARCHAR)] AS key_events,
       {_COUNTRY_IDS} AS affected_countries,
       'v' || CAST({_K} % 3 AS VARCHAR) AS model_version,
       MAP {{'geopolitical_events': {_K} / 100.0::DOUBLE, 'production_data': 1 - {_K} / 100.0::DOUBLE}}
         AS feature_importance
FROM events WHERE event_type = 'purchase'""",
    "v_country_event_edge": """
SELECT 'ce:' || CAST(id AS VARCHAR) || ':' || CAST(pos - 1 AS VARCHAR) AS id, 'c:' || country AS source,
       'e:' || CAST(id AS VARCHAR) AS target, id % 101 / 100.0::DOUBLE AS weight,
       CASE WHEN id % 2 = 0 THEN 'causation' ELSE 'correlation' END AS type
FROM (SELECT id, unnest(countries) AS country, generate_subscripts(countries, 1) AS pos FROM v_event) x""",
    "v_event_price_edge": """
SELECT 'pe:' || CAST(id AS VARCHAR) AS id, 'e:' || CAST(id AS VARCHAR) AS source, 'p:current' AS target,
       immediate AS weight, 'influence' AS type
FROM v_event WHERE immediate IS NOT NULL""",
}

# Graph node / edge tables built on the views (same definitions as
# petrograph.operators.graph).
VIEWS["g_nodes"] = f"""
SELECT 'c:' || id AS id, name AS label, 'country' AS type,
       25.0 + {Q.or_zero('oil_production')} / 1000000.0 AS size, '#f97316' AS colour,
       code, oil_production, CAST(NULL AS VARCHAR) AS severity, CAST(NULL AS DOUBLE) AS immediate,
       CAST(NULL AS DOUBLE) AS price
FROM v_country
UNION ALL
SELECT 'e:' || CAST(id AS VARCHAR) AS id, {Q.label_prefix('title')} AS label, 'event' AS type,
       15.0 + coalesce(immediate * 15.0, 0.0) AS size, {Q.event_node_colour('severity')} AS colour,
       NULL, NULL, severity, immediate, NULL
FROM v_event
UNION ALL
SELECT 'p:current' AS id, 'Current Price' AS label, 'price_point' AS type, 20.0 AS size, '#10b981' AS colour,
       NULL, NULL, NULL, NULL, arg_max(price, (ts, id)) AS price
FROM v_tick WHERE price_type = 'WTI'"""

VIEWS["g_edges"] = """
SELECT id, source, target, weight, type FROM v_country_event_edge
UNION ALL
SELECT id, source, target, weight, type FROM v_event_price_edge"""

_ORDER = ["v_country", "v_event", "v_price", "v_tick", "v_prediction", "v_country_event_edge",
          "v_event_price_edge", "g_nodes", "g_edges"]


def _deps(sql: str) -> set[str]:
    return {m for m in re.findall(r"\b([vg]_[a-z_]+)\b", sql) if m in VIEWS}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the CTEs of every view it (transitively) uses."""
    need: set[str] = set()
    todo = list(_deps(sql))
    while todo:
        v = todo.pop()
        if v in need:
            continue
        need.add(v)
        todo.extend(_deps(VIEWS[v]) - need)
    if not need:
        return sql.strip()
    ctes = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in _ORDER if v in need)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
