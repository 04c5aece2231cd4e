"""Compare a query with its SQL in DuckDB on one folder of tables."""

import decimal
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def _plain(v):
    return round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else v


def connect(folder: str = SF):
    c = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)


def expected(sql: str, folder: str = SF):
    r = connect(folder).execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(_plain(x[i]) for i in order) for x in r.fetchall()), key=repr)
