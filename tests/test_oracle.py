"""Every registered query against its DuckDB oracle at sf0.01 (the driver's
correctness gate, run locally), plus the rows-only queries."""

from __future__ import annotations

import pytest

from petrograph.plans.registry import load_all
from tests.conftest import SF001
from tests.oracle import compare, duck

REG = load_all()
WITH_SQL = sorted(n for n, q in REG.items() if q.sql)
ROWS_ONLY = sorted(n for n, q in REG.items() if not q.sql)


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_oracle(spark, con, name):
    ok, msg = compare(spark, con, REG[name], SF001)
    assert ok, f"{name}: {msg}"


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only(spark, name):
    assert REG[name].build(spark, SF001).count() > 0
