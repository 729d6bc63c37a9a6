"""Compare a registered query with its SQL on the same tables."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from limewash.catalog.messy import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"f{value!r}"
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return repr(value)
    if isinstance(value, int):
        return f"i{value}"
    if isinstance(value, decimal.Decimal):
        return f"d{value}"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return f"t{value}"
    return repr(value)


def spark_rows(df):
    names = sorted(df.columns)
    rows = [tuple(plain(r[n]) for n in names) for r in df.collect()]
    return names, sorted(rows)


def sql_rows(con, sql):
    cur = con.execute(sql)
    header = [d[0] for d in cur.description]
    order = sorted(range(len(header)), key=lambda i: header[i])
    rows = [tuple(plain(r[i]) for i in order) for r in cur.fetchall()]
    return [header[i] for i in order], sorted(rows)


def difference(df, con, sql) -> str | None:
    names, got = spark_rows(df)
    want_names, want = sql_rows(con, sql)
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}; got {got[:3]} want {want[:3]}"
    for a, b in zip(got, want):
        if a != b:
            return f"row {a} != {b}"
    return None
