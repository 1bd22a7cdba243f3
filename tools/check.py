"""Run queries on Spark and their SQL on DuckDB over one folder of tables and compare the results.

    python tools/check.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from semaspan.session import local_session  # noqa: E402
from semaspan.workload.oracles import ORACLES  # noqa: E402
from semaspan.workload.queries import QUERIES  # noqa: E402


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty if the two tables hold the same rows in any order, else what differs first."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    columns = sorted(got.columns)
    # a whole-number column with nulls arrives as float on one side only
    for df in (got, want):
        for c in columns:
            if df[c].isna().any() and df[c].dtype.kind in "iuf" and (df[c].dropna() % 1 == 0).all():
                df[c] = df[c].astype("float64")

    def lines(df: pd.DataFrame) -> list[str]:
        text = pd.DataFrame({
            c: df[c].astype(object).map(lambda v: "NULL" if v is None or v is pd.NA or v != v else (f"{v:.6f}" if isinstance(v, float) else str(v)))
            for c in columns
        })
        return sorted(text.agg("|".join, axis=1).tolist()) if len(text) else []

    g, w = lines(got), lines(want)
    for a, b in zip(g, w):
        if a != b:
            differing = sum(x != y for x, y in zip(g, w))
            return f"{differing} rows differ, first {a!r} != {b!r}"
    for c in columns:
        if got[c].dtype.kind != want[c].dtype.kind and not (got[c].dtype.kind in "OUT" or want[c].dtype.kind in "OUT"):
            return f"type of {c}: {got[c].dtype} != {want[c].dtype}"
    return ""


def main(sf: str, names: list[str]) -> int:
    spark = local_session(8)
    con = connect(sf)
    bad = 0
    for name in names or list(QUERIES):
        start = time.time()
        try:
            got = QUERIES[name](spark, sf).toPandas()
            middle = time.time()
            if name in ORACLES:
                difference = compare(got, con.execute(ORACLES[name]).df())
            else:
                difference = "" if len(got) else "no rows"
            status = "ok" if not difference else f"DIFFERENT: {difference[:400]}"
            if name not in ORACLES and not difference:
                status = "rows only"
            print(f"{name:24s} {status}  rows={len(got)} spark={middle - start:.1f}s duckdb={time.time() - middle:.1f}s", flush=True)
            bad += bool(difference)
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"{name:24s} FAILED: {type(error).__name__}: {str(error)[:600]}", flush=True)
    print(f"{bad} of {len(names or QUERIES)} not equal")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
