"""Spark rows against DuckDB rows of the same tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(directory=DATA):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in Path(directory).glob("*.parquet"):
        c.execute(f"CREATE VIEW \"{f.stem}\" AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, float):
        # not a number equals nothing, so no result may have it
        assert not math.isnan(v)
        return repr(round(v, 9) + 0.0)
    if isinstance(v, decimal.Decimal):
        return str(int(v)) if v == v.to_integral_value() else repr(float(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def same(df, connection, sql):
    got = sorted(plain([r[c] for c in sorted(df.columns)]) for r in df.collect())
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    assert got == sorted(plain([r[i] for i in at]) for r in cursor.fetchall())
