"""Side-by-side run of a query and its SQL."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def normal(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(normal, v))
    if hasattr(v, "as_integer_ratio"):
        return float(f"{float(v):.9g}")
    return str(v)


def connect(folder):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}/*.parquet')" if p.is_dir() else f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def compare(spark, con, query, sql, folder):
    """None if both give the same rows, else what differs."""
    df = query(spark, folder)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want = Counter(tuple(normal(v) for _, v in sorted(zip(names, r))) for r in cur.fetchall())
    got = Counter(tuple(normal(v) for _, v in sorted(zip(df.columns, r))) for r in df.collect())
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only Spark {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
    return None if got else "no rows"
