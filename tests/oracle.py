"""Compares a query with its SQL, as rows of text in any order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _text(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return f"{v:.9g}"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(_text(r[i]) for i in order) for r in rows], key=str)


def assert_same(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    out = con.sql(sql)
    assert sorted(df.columns) == sorted(out.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(out.columns, out.fetchall())
