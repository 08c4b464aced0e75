"""Runs a query and its SQL on the same tables and returns both as sorted rows."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(folder, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: round(x, 6) if isinstance(x, float) and not math.isnan(x) else x
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str), [columns[i] for i in order]


def both(spark, folder, query, sql):
    df = query(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = connect(folder).execute(sql)
    want = rows([c[0] for c in found.description], found.fetchall())
    return got, want
