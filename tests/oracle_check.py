"""Order-insensitive comparison of a Spark query with its DuckDB oracle.

Values are normalised (decimals and floats to 6 places, timestamps to ISO
text, structs to sorted key/value tuples, arrays element-wise) and the two
row multisets are compared, column names sorted.
"""

from __future__ import annotations

import datetime as dt
import decimal
from collections import Counter

import duckdb

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
               "pages benchmark labels conversations").split()


def duck_connection(sf_dir: str):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir.rstrip('/')}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (decimal.Decimal, float)):
        return round(float(v), 6)
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, [tuple(norm(r[c]) for c in cols) for r in df.select(*cols).collect()]


def duck_rows(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(norm(r[i]) for i in order) for r in rel.fetchall()]


def compare(df, con, sql) -> dict:
    s_cols, s_rows = spark_rows(df)
    d_cols, d_rows = duck_rows(con, sql)
    res = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows), "columns_match": s_cols == d_cols}
    if s_cols != d_cols:
        res["spark_cols"], res["oracle_cols"] = s_cols, d_cols
    cs, cd = Counter(s_rows), Counter(d_rows)
    res["values_match"] = cs == cd
    if cs != cd:
        res["only_spark"] = list((cs - cd).elements())[:3]
        res["only_oracle"] = list((cd - cs).elements())[:3]
    res["ok"] = res["columns_match"] and res["values_match"]
    return res
