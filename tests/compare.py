"""Rows of a query and of its SQL, as comparable texts."""

import decimal
import math


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    return str(v)


def same(query, sql, spark, sf, duck):
    df = query(spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(sql)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert got == want
