"""Runs queries beside their SQL in DuckDB: ``python tests/oracle.py [--sf DIR] [NAME ...]``."""

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return datetime.datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, list | tuple) or hasattr(v, "tolist"):
        return tuple(plain(x) for x in v)
    if isinstance(v, int):
        return float(f"{float(v):.9g}")
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([plain(r[i]) for i in order] for r in data), key=repr)


def connection(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    return con


def fetched(con, sql):
    rel = con.sql(sql)
    return list(rel.columns), rel.fetchall()


def compare(spark, con, name, sf):
    """None if the rows are equal, else what differs."""
    import __spark_entry__ as e

    df = e.queries()[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    sql = e.oracle_sql().get(name)
    if sql is None:
        return None if got[1] else "no rows"
    want = rows(*fetched(con, sql))
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] == want[1]:
        return None
    odd = [(a, b) for a, b in zip(got[1], want[1]) if a != b][:2]
    return f"{len(got[1])} and {len(want[1])} rows; {str(odd)[:900]}"


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args.pop(args.index("--sf") + 1) if "--sf" in args else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("--")]
    import __spark_entry__ as entry

    from paperloom.session import local_session

    spark, con, bad = local_session(8, 8), connection(sf), 0
    for name in names or entry.queries():
        if not names and name.split("_")[0] in ("p2", "p3", "p4", "p5", "p6", "p7", "p8"):
            continue
        t = time.time()
        try:
            why = compare(spark, con, name, sf)
        except Exception as x:
            why = f"{type(x).__name__}: {str(x)[:700]}"
        if why:
            bad += 1
            print("BAD", name, why, flush=True)
        elif time.time() - t > 4:
            print("slow", name, round(time.time() - t, 1), flush=True)
    print("different:", bad)
