"""The rounding and text rules give identical results in Spark and in their
DuckDB spelling (the oracle relies on it), on random doubles including ties."""

from __future__ import annotations

import random

import duckdb
import pytest

from petrograph.functions import exprs as X
from petrograph.functions import sqltext as Q


def _values(n=400, seed=11):
    rnd = random.Random(seed)
    out = [0.0, -0.0, 0.5, -0.5, 1.005, 2.675, 0.125, -0.125, 1e-9, -1e-9, 123456789.125, 9.995]
    for _ in range(n):
        k = rnd.choice([0, 1, 2, 3])
        if k == 0:
            out.append(rnd.uniform(-1e6, 1e6))
        elif k == 1:
            out.append(round(rnd.uniform(-1000, 1000), rnd.choice([1, 2, 3])) + rnd.choice([0, 0.005, 0.0005]))
        elif k == 2:
            out.append(rnd.randrange(-10**6, 10**6) / 8)   # exact binary ties
        else:
            out.append(rnd.uniform(-1, 1))
    return out


CASES = [
    ("round2", lambda c: X.round_fixed(c, 2), lambda e: Q.round_fixed(e, 2)),
    ("round0", lambda c: X.round_fixed(c, 0), lambda e: Q.round_fixed(e, 0)),
    ("fixed1", lambda c: X.to_fixed(c, 1), lambda e: Q.to_fixed(e, 1)),
    ("fixed2", lambda c: X.to_fixed(c, 2), lambda e: Q.to_fixed(e, 2)),
    ("pct0", lambda c: X.pct_text(c, 0), lambda e: Q.pct_text(e, 0)),
    ("number", X.fmt_number, Q.fmt_number),
    ("currency", X.fmt_currency, Q.fmt_currency),
]


@pytest.mark.parametrize("name,spark_fn,sql_fn", CASES, ids=[c[0] for c in CASES])
def test_spark_and_duckdb_agree(spark, name, spark_fn, sql_fn):
    vals = _values()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i long, x double")
    got = {r["i"]: r["r"] for r in df.select("i", spark_fn(df["x"]).alias("r")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i BIGINT, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(vals)))
    want = dict(con.execute(f"SELECT i, {sql_fn('x')} FROM t").fetchall())
    diff = [(vals[i], got[i], want[i]) for i in got if got[i] != want[i]]
    assert not diff, diff[:5]
