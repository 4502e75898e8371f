"""Runs a query and its SQL side by side."""

import math

import duckdb


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "item"):
        return v.item()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name, query, sql, sf_dir):
    """Asserts equal column names and rows; gives back the number of rows."""
    df = query(spark, sf_dir)
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    want = rows_of([d[0] for d in got.description], got.fetchall())
    have = rows_of(df.columns, df.collect())
    assert have[0] == want[0], (name, have[0], want[0])
    assert len(have[1]) == len(want[1]), (name, len(have[1]), len(want[1]))
    assert have[1] == want[1], (name, [x for x in zip(have[1], want[1]) if x[0] != x[1]][:3])
    return len(want[1])
