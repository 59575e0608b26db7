"""Runs a query in Spark and its SQL in DuckDB and compares rows, whatever their order."""

import math

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, (float, np.floating)) and math.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return round(float(v), 6)
    return str(v)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=repr)


def duck_rows(sql, sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    q = c.execute(sql)
    names = [x[0] for x in q.description]
    columns = sorted(names)
    at = [names.index(x) for x in columns]
    return columns, sorted([tuple(plain(r[i]) for i in at) for r in q.fetchall()], key=repr)
