"""Runs a registered query beside its SQL over one of the driver's folders."""

import os
from collections import Counter

import duckdb


def views(sf_dir):
    db = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
        db.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}'")
    return db


def plain(v):
    return None if v is None or v != v else v


def same_rows(df, sql, sf_dir):
    names = sorted(df.columns)
    got = Counter(tuple(str(v) for v in r) for r in df.select(*names).collect())
    cursor = views(sf_dir).execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names, (columns, names)
    order = [columns.index(n) for n in names]
    want = Counter(tuple(str(plain(r[k])) for k in order) for r in cursor.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3], got.total(), want.total())
    return got.total()
