"""Runs registered queries against their DuckDB texts on one data folder."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, int):
        return f"i:{v}"
    if isinstance(v, float):
        return "f:nan" if math.isnan(v) else f"f:{v!r}"
    if isinstance(v, decimal.Decimal):
        return f"d:{v}"
    if isinstance(v, dt.datetime):
        return f"t:{v.isoformat()}"
    if isinstance(v, dt.date):
        return f"D:{v.isoformat()}"
    if isinstance(v, str):
        return f"s:{v}"
    return f"{type(v).__name__}:{v}"


def normal(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted(tuple(cell(r[i]) for i in at) for r in rows)


def compare(df, con, sql) -> str:
    """'' when both sides agree, else what differs."""
    t0 = time.time()
    sc, sr = normal(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    cur = con.execute(sql)
    if "-v" in sys.argv:
        print(f"   spark {t1 - t0:.1f}s sql {time.time() - t1:.1f}s")
    oc, orows = normal([d[0] for d in cur.description], cur.fetchall())
    if sc != oc:
        return f"columns {sc} / {oc}"
    if len(sr) != len(orows):
        return f"rows {len(sr)} / {len(orows)}; only spark {list(set(sr) - set(orows))[:2]} only sql {list(set(orows) - set(sr))[:2]}"
    if sr != orows:
        a, b = sorted(set(sr) - set(orows)), sorted(set(orows) - set(sr))
        return f"{len(a)} of {len(sr)} rows differ: {a[:2]} / {b[:2]}"
    return ""


def main(patterns: list[str], sf_dir: str = "/root/testdata/sf0.01") -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as e
    from spendlens.session import local_session

    patterns = [p for p in patterns if p != "-v"]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    sqls = e.oracle_sql()
    for name, fn in e.queries().items():
        if patterns and not any(p in name for p in patterns):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                msg, rows = compare(df, con, sqls[name]), ""
            else:
                msg, rows = "", f" rows={df.count()} (no oracle)"
        except Exception as ex:  # report and go on
            msg, rows = f"{type(ex).__name__}: {str(ex)[:700]}", ""
        bad += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '} {name} {time.time() - t:.1f}s{rows} {msg}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
