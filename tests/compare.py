"""Run catalogue queries and their SQL side by side. ``python -m tests.compare [sf] [name ...]``"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd

DATA = Path("/root/testdata")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/sf{sf}/{t}.parquet')")
    return con


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(cell(x) for x in v)
    if isinstance(v, pd.Timestamp):
        return str(v.tz_localize(None) if v.tzinfo else v)
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, float) or hasattr(v, "dtype"):
        return float(v)
    if isinstance(v, int):
        return float(v)
    return str(v) if not isinstance(v, str) else v


def bag(pdf: pd.DataFrame) -> Counter:
    cols = sorted(pdf.columns)
    return Counter(tuple(cell(v) for v in row) for row in pdf[cols].astype(object).itertuples(index=False, name=None))


def differences(spark_pdf: pd.DataFrame, sql_pdf: pd.DataFrame) -> str | None:
    if sorted(spark_pdf.columns) != sorted(sql_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} / {sorted(sql_pdf.columns)}"
    a, b = bag(spark_pdf), bag(sql_pdf)
    if a == b:
        return None
    only_a, only_b = list((a - b).items())[:3], list((b - a).items())[:3]
    return (f"rows {len(spark_pdf)} / {len(sql_pdf)}; {sum((a - b).values())} only in Spark, {sum((b - a).values())} only in SQL; "
            f"columns {sorted(spark_pdf.columns)}\n    spark {only_a}\n    sql   {only_b}")


def main(argv: list[str]) -> int:
    from millrace.plans.catalogue import ORACLES, QUERIES
    from tests.conftest import make_spark

    sf = argv[0] if argv else "0.01"
    names = argv[1:] or list(QUERIES)
    spark = make_spark()
    con = connect(sf)
    bad = 0
    for name in names:
        begin = time.time()
        try:
            got = QUERIES[name](spark, f"{DATA}/sf{sf}").toPandas()
            took = time.time() - begin
            want = con.execute(ORACLES[name]).df() if name in ORACLES else None
            fault = differences(got, want) if want is not None else None
            state = "rows-only" if want is None else "ok" if fault is None else "DIFF"
        except Exception as e:  # report and go on with the next query
            took, fault, state, got = time.time() - begin, f"{type(e).__name__}: {str(e)[:1500]}", "ERROR", ()
        bad += state in ("DIFF", "ERROR")
        print(f"{state:9s} {name:28s} rows={len(got):7d} {took:6.1f}s" + (f"\n    {fault}" if fault else ""), flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
