"""A query beside its SQL on the test tables."""

import datetime
import decimal
from pathlib import Path

import duckdb


def _plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v


def same(spark, query, sql: str, folder: str) -> None:
    df = query(spark, folder)
    columns = sorted(df.columns)
    ours = sorted(repr([_plain(r[c]) for c in columns]) for r in df.collect())
    con = duckdb.connect()
    for p in Path(folder).iterdir():
        con.execute(f"CREATE VIEW \"{p.name.split('.')[0]}\" AS SELECT * FROM read_parquet('{p}')")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted(repr([_plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())
    assert ours == theirs
