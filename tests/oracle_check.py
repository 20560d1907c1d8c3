"""Runs registered queries next to their SQL in DuckDB and compares every row."""
from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    spent = time.time() - t0
    if sql is None:
        return len(got), spent, None
    t0 = time.time()
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    duck_spent = time.time() - t0
    gc, g = rows_of(df.columns, got)
    wc, w = rows_of(cols, want)
    if gc != wc:
        return len(got), spent, f"columns {gc} != {wc}"
    if g != w:
        return len(got), spent, (f"{len(got)} rows vs {len(want)}; only spark {list((g - w).items())[:3]}; "
                                 f"only sql {list((w - g).items())[:3]}")
    return len(got), spent, "ok" if duck_spent < 20 else f"ok (sql {duck_spent:.0f}s)"


if __name__ == "__main__":
    from fieldledger.session import local_session
    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session("check")
    con = duck(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            n, spent, verdict = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as exc:  # report and go on with the next query
            n, spent, verdict = 0, 0.0, f"{type(exc).__name__}: {str(exc)[:600]}"
        flag = "" if verdict is None or verdict.startswith("ok") else "FAIL "
        bad += bool(flag)
        empty = " EMPTY" if n == 0 else ""
        print(f"{flag}{name}: rows={n} {spent:.2f}s {verdict}{empty}", flush=True)
    print("failures", bad)
