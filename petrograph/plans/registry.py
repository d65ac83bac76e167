"""Query registry: name -> Spark builder (+ DuckDB oracle SQL when one exists)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from petrograph.plans.oracle_views import with_views

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    ref: str
    build: Builder
    sql: str | None     # None: no SQL twin (rows-only check)


REGISTRY: dict[str, Query] = {}


def query(name: str, ref: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, ref, fn, with_views(sql) if sql else None)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # Importing the modules registers their queries.
    from petrograph.operators import (aggregates, derived, forecast, formats, graph,  # noqa: F401
                                      lookups, quality, reports, scans, sequences, throttle)
    from petrograph.streaming import streams  # noqa: F401
    return REGISTRY
