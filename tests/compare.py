"""Compares a query with its SQL in DuckDB, order aside."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf, sql):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con.execute(sql).df()


def assert_same(got, want):
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    texts = [f[cols].astype("object").where(f[cols].notna(), None).map(lambda x: str(int(x)) if isinstance(x, float) and x == int(x) else str(x)).sort_values(cols).reset_index(drop=True) for f in (got, want)]
    assert len(texts[0]) == len(texts[1])
    differing = (texts[0] != texts[1]).any(axis=1)
    assert not differing.any(), f"{differing.sum()} rows differ:\n{texts[0][differing].head(3)}\n{texts[1][differing].head(3)}"
