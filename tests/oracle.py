"""Spark-vs-DuckDB comparison used by the tests (and runnable by hand).

    python -m tests.oracle [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys

import duckdb
import pandas as pd

from petrograph.sources.tables import TABLES, table_path


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, pd.Timestamp):
        v = v.to_pydatetime()
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].astype(object).itertuples(index=False, name=None):
        out.append(tuple(_norm(None if (isinstance(x, float) and math.isnan(x)) or x is pd.NaT else x)
                         for x in rec))
    return sorted(out, key=repr)


def compare(spark, con, q, sf_dir: str) -> tuple[bool, str]:
    sdf = q.build(spark, sf_dir)
    left = sdf.toPandas()
    right = con.execute(q.sql).df()
    if sorted(left.columns) != sorted(right.columns):
        return False, f"columns differ: {sorted(left.columns)} vs {sorted(right.columns)}"
    a, b = rows(left), rows(right)
    if len(a) != len(b):
        return False, f"row count {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} rows differ, first: {bad[0][0]} vs {bad[0][1]}"
    return True, f"{len(a)} rows"


def main(argv: list[str]) -> int:
    from petrograph.plans.registry import load_all
    from petrograph.session import build_session

    sf_dir = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        sf_dir, argv = argv[0], argv[1:]
    reg = load_all()
    names = argv or [n for n, q in reg.items() if q.sql]
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    failed = 0
    for n in names:
        q = reg[n]
        if not q.sql:
            cnt = q.build(spark, sf_dir).count()
            print(f"ROWS  {n}: {cnt} rows (no oracle)")
            continue
        try:
            ok, msg = compare(spark, con, q, sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"error: {type(e).__name__}: {str(e)[:400]}"
        failed += not ok
        print(f"{'OK  ' if ok else 'FAIL'}  {n}: {msg}", flush=True)
    print(f"{len(names) - failed}/{len(names)} passed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
