"""Runs registered queries next to their SQL and compares whole results."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, dt.datetime) and v.tzinfo:
        return v.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return v


def compare(spark, con, build, sql: str, sf: str) -> tuple[bool, str]:
    df = build(spark, sf)
    names = sorted(df.columns)
    mine = [tuple(_norm(v) for v in r) for r in df.select(*names).collect()]
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return False, f"columns {names} != {sorted(rel.columns)}"
    order = [rel.columns.index(n) for n in names]
    theirs = [tuple(_norm(r[i]) for i in order) for r in rel.fetchall()]
    if len(mine) != len(theirs):
        return False, f"rows {len(mine)} != {len(theirs)}"
    key = lambda r: tuple((v is None, str(type(v)) if not isinstance(v, (int, float)) else "n", v if v is not None else 0) for v in r)
    a, b = sorted(mine, key=key), sorted(theirs, key=key)
    for x, y in zip(a, b):
        if x != y:
            return False, f"{names}: {x} != {y}"
    return True, f"{len(mine)} rows"


if __name__ == "__main__":
    from leafgrade.plans import registry
    import leafgrade.plans as plans
    from leafgrade.session import local_session

    sf = "/root/testdata/sf0.01"
    args = sys.argv[1:]
    if args and args[0].startswith("/"):
        sf, args = args[0], args[1:]
    mods = [a[1:] for a in args if a.startswith("@")]
    for m in mods or plans.MODULES:
        plans.import_module(f"leafgrade.plans.{m}")
    wanted = [a for a in args if not a.startswith("@")]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    for name, q in registry.QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        t0 = time.time()
        try:
            if q.sql:
                ok, note = compare(spark, con, q.build, q.sql, sf)
            else:
                ok, note = True, f"no sql, {q.build(spark, sf).count()} rows"
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        print("ok  " if ok else "FAIL", name, f"{time.time() - t0:.1f}s", note, flush=True)
