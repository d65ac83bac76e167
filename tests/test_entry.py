"""The driver contract in __spark_entry__.py."""

from __future__ import annotations

import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs_on_smoke_data(spark):
    df = _entry_module().entry(spark)
    rows = df.collect()
    assert len(rows) == 5
    assert df.columns == ["id", "ts", "title", "codes", "overflow", "severity", "severity_colour",
                          "impact_band", "impact_pct"]


def test_oracle_keys_are_query_keys():
    m = _entry_module()
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80
    assert all(callable(f) for f in q.values())
