"""Compares a query's rows with those of its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
    return repr(x)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in found)


def difference(df, con, sql):
    """None, or what differs."""
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs = rows([d[0] for d in cur.description], cur.fetchall())
    if ours == theirs:
        return None
    if ours[0] != theirs[0] or len(ours[1]) != len(theirs[1]):
        return f"{ours[0]} {theirs[0]} {len(ours[1])} {len(theirs[1])} {ours[1][:1]} {theirs[1][:1]}"
    return next(f"{a} {b}" for a, b in zip(ours[1], theirs[1], strict=True) if a != b)
