"""Compares registered queries with their SQL in DuckDB: ``python tests/oracle.py SF_DIR [NAME...]``."""

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        at = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"create view {name} as select * from read_parquet('{at}')")
    return con


def compare(spark, con, sf_dir, run, sql):
    """None if both give the same columns and rows, else what differs."""
    from collections import Counter

    df = run(spark, sf_dir)
    if sql is None:
        return None if df.count() >= 0 else "no rows"
    columns = sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    order = [names.index(c) for c in columns]
    theirs = Counter(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    if ours != theirs:
        return f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list((ours - theirs).items())[:2]}; only SQL {list((theirs - ours).items())[:2]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as e
    from strandloom.session import local_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = duck(sf), e.oracle_sql()
    for name, run in e.queries().items():
        if not names or name in names:
            began = time.time()
            try:
                found = compare(spark, con, sf, run, sql.get(name))
            except Exception as x:
                found = f"{type(x).__name__}: {str(x)[:600]}"
            print(f"{name:28} {time.time() - began:6.1f} s {'SQL ' if name in sql else 'rows'} {found or 'ok'}", flush=True)
    os._exit(0)
