"""Run queries against their SQL. Used by the tests; also: python -m tests.oracle NAME..."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
import pandas as pd


def duck(sf: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{src}')")
    return con.execute(sql).df()


def norm(df: pd.DataFrame) -> list[tuple]:
    def v(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return None
        if isinstance(x, bool):
            return x
        if hasattr(x, "tolist") and not isinstance(x, (str, bytes)):
            x = x.tolist()
        if isinstance(x, (list, tuple)):
            return tuple(v(y) for y in x)
        if isinstance(x, float):
            return int(x) if x == int(x) and abs(x) < 1e15 else round(x, 6)
        return str(x) if not isinstance(x, (int, str)) else x

    cols = sorted(df.columns)
    return sorted((tuple(v(x) for x in r) for r in df[cols].itertuples(index=False)), key=repr)


def compare(spark, sf: str, name: str) -> str:
    import __spark_entry__ as e

    t = time.time()
    got = e.queries()[name](spark, sf).toPandas()
    took = time.time() - t
    sql = e.oracle_sql().get(name)
    if sql is None:
        return f"ok   {name}: {len(got)} rows, no SQL ({took:.1f} s)"
    want = duck(sf, sql)
    if sorted(got.columns) != sorted(want.columns):
        return f"FAIL {name}: columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = norm(got), norm(want)
    if a != b:
        only = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"FAIL {name}: {len(a)} and {len(b)} rows; only Spark {only[0]}; only SQL {only[1]}"
    return f"ok   {name}: {len(a)} rows ({took:.1f} s)"


def session():
    from tidemark.session import get_session

    s = get_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    return s


if __name__ == "__main__":
    import __spark_entry__ as e

    sf = os.environ.get("SF", "/root/testdata/sf0.01")
    spark = session()
    for n in sys.argv[1:] or e.queries():
        hits = [q for q in e.queries() if q == n or (n.endswith("*") and q.startswith(n[:-1]))]
        for q in hits:
            try:
                print(compare(spark, sf, q), flush=True)
            except Exception as x:  # noqa: BLE001
                print(f"FAIL {q}: {type(x).__name__} {str(x)[:1500]}", flush=True)
