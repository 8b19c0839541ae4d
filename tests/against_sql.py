"""Compares a query with its SQL on the same tables."""

from __future__ import annotations

import os

import duckdb

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _plain(v):  # noqa: ANN001, ANN202
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return tuple(_plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def check(spark, query, sql: str, folder: str = FOLDER) -> None:  # noqa: ANN001
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    df = query(spark, folder)
    columns = sorted(df.columns)
    found = sorted(repr(tuple(_plain(v) for v in r)) for r in df.select(*columns).collect())
    want = con.sql(sql)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert found == sorted(repr(tuple(_plain(r[i]) for i in at)) for r in want.fetchall())
