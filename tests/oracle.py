"""Run queries against their SQL in DuckDB and compare whole results.

``python tests/oracle.py [sf_dir] [name ...]``
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as contract  # noqa: E402

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "documents", "benchmark", "pages", "labels")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _sorted(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """'' when equal, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    got, want = _sorted(got), _sorted(want)
    for c in got.columns:
        kinds = {got[c].dtype.kind, want[c].dtype.kind}
        nullable = got[c].isna().any() or want[c].isna().any()
        if len(kinds) > 1 and len(got) and not nullable and not kinds <= {"O", "b"}:
            return f"{c}: type {got[c].dtype} != {want[c].dtype}"
        a, b = got[c], want[c]
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            i = same.idxmin()
            return f"{c}: {(~same).sum()} values differ, first {a[i]!r} != {b[i]!r}"
    return ""


def main() -> None:
    from conftest import session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = session()
    con = connect(sf_dir)
    queries, oracles = contract.queries(), contract.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            t_spark = time.time() - start
            if name in oracles:
                want = con.execute(oracles[name]).df()
                problem = compare(got, want)
            else:
                problem = ""
            kind = "sql" if name in oracles else "rows"
        except Exception as e:  # noqa: BLE001
            problem, t_spark, got, kind = f"{type(e).__name__}: {str(e)[:600]}", 0, [], "error"
        bad += bool(problem)
        total = time.time() - start
        print(f"{'FAIL' if problem else 'ok  '} {name} {kind} rows={len(got)} spark={t_spark:.1f}s all={total:.1f}s {problem}", flush=True)
    print(f"{bad} problems")


if __name__ == "__main__":
    main()
