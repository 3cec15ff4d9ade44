"""Run a query and its SQL side by side."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _key(rows):
    return sorted((tuple((0, "") if x is None or isinstance(x, float) and math.isnan(x) else (1, x) for x in r) for r in rows), key=repr)


def same(df, sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    columns = sorted(df.columns)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    ours, theirs = _key(df.select(*columns).collect()), _key([[r[k] for k in at] for r in cursor.fetchall()])
    assert ours == theirs
