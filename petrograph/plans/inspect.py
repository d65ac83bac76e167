"""Plan inspection helpers used by tests and when reviewing plans by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame


def plan_text(df: DataFrame) -> str:
    """The physical plan (AQE's initial plan) as text."""
    return df._jdf.queryExecution().executedPlan().toString()


def _children(node):
    ch = node.children()
    return [ch.apply(i) for i in range(ch.size())]


def _name(node) -> str:
    return node.getClass().getSimpleName()


def _all_paths_aggregate(node) -> bool:
    """True when every path from ``node`` down to a leaf passes an Aggregate."""
    if _name(node) == "Aggregate":
        return True
    kids = _children(node)
    if not kids:
        return False
    return all(_all_paths_aggregate(k) for k in kids)


def global_windows(df: DataFrame) -> list[str]:
    """Windows without PARTITION BY whose input is not an aggregated table.

    Such a window gathers all its input rows into one task; over a per-bucket
    or per-partition summary that is fine, over raw rows it is not.
    """
    bad = []
    stack = [df._jdf.queryExecution().optimizedPlan()]
    while stack:
        node = stack.pop()
        if _name(node) == "Window" and node.partitionSpec().isEmpty():
            if not all(_all_paths_aggregate(k) for k in _children(node)):
                bad.append(node.toString()[:200])
        stack.extend(_children(node))
    return bad


_OPS = ("Exchange", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
        "Window", "HashAggregate", "SortAggregate", "ObjectHashAggregate")


def op_counts(df: DataFrame) -> dict[str, int]:
    """Count physical operators in the (initial) plan: shuffles, joins, windows, aggregates."""
    counts = dict.fromkeys(_OPS, 0)
    stack = [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        name = _name(node)
        if name == "AdaptiveSparkPlanExec":
            stack.append(node.initialPlan())
            continue
        if name == "ShuffleExchangeExec":
            counts["Exchange"] += 1
        elif name == "BroadcastExchangeExec":
            counts["BroadcastExchange"] += 1
        else:
            base = name[:-4] if name.endswith("Exec") else name
            if base in counts:
                counts[base] += 1
        stack.extend(_children(node))
    return {k: v for k, v in counts.items() if v}
