"""Run registered queries and their SQL side by side: ``python -m checks.compare [sf] [name prefix ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from moneytrail.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, type(v).__name__, v) for v in row)


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=_key)


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b and type(a) is type(b)


def compare(spark, con, name, fn, body, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    if body is None:
        return f"rows-only {len(got)}", spent
    rel = con.sql(body)
    want_cols, want = rows_of(rel.columns, rel.fetchall())
    if got_cols != want_cols:
        return f"COLUMNS {got_cols} != {want_cols}", spent
    if len(got) != len(want):
        miss = [r for r in want if r not in set(got)][:2] if len(want) < 200000 else ""
        more = [r for r in got if r not in set(want)][:2] if len(want) < 200000 else ""
        return f"ROWS {len(got)} != {len(want)} missing={miss} extra={more}", spent
    exact = got == want
    if exact:
        bad_types = {c for c, a, b in zip(got_cols, got[0], want[0]) if type(a) is not type(b)} if got else set()
        return (f"ok {len(got)}" if got else "ok EMPTY") + (f" TYPES {bad_types}" if bad_types else ""), spent
    for a, b in zip(got, want):
        if not all(close(x, y) for x, y in zip(a, b)):
            diff = [(c, x, y) for c, x, y in zip(got_cols, a, b) if not close(x, y)]
            ids = [(c, x) for c, x in zip(got_cols, a) if c in ("id", "account")]
            return f"VALUES {diff[:4]} at {ids}", spent
    return f"close {len(got)} (not bit-equal)", spent


def main():
    from checks import all_queries
    queries, oracle = all_queries()
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                         "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            verdict, spent = compare(spark, con, name, fn, oracle.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            verdict, spent = f"ERROR {type(e).__name__} {str(e)[:600]}", 0.0
        bad += not verdict.startswith(("ok", "rows-only"))
        print(f"{name:34s} {spent:6.2f}s {verdict}", flush=True)
    print(f"{bad} to look at")


if __name__ == "__main__":
    main()
