"""Compare registered queries with their SQL in DuckDB, as sorted rows by column name."""

import glob
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


def compare(spark, con, folder, query, sql):
    """None if equal, else what differs."""
    df = query(spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall()), key=repr)
    if got != want:
        only = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
        return f"{len(got)} and {len(want)} rows, {only}"
    return None
