"""Running a query and its SQL side by side."""

import decimal
import glob
import math
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def same(spark, con, folder, query, sql):
    df = query(spark, folder)
    columns = sorted(df.columns)
    left = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    right = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)
    assert left == right
