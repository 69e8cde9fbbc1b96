"""Rows of a query against those of its SQL."""

import os


def oracle(sql, sf):
    """Rows of DuckDB SQL over the tables in ``sf``."""
    import glob

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con.sql(sql).df()


def canonical(df):
    """Columns by name, rows in order, nulls alike."""
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if not (df[c].dtype.kind in "iufb"):
            df[c] = df[c].map(lambda x: None if x is None or x != x else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def same(a, b):
    a, b = canonical(a), canonical(b)
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    for c in a.columns:
        equal = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        assert equal.all(), (c, a[c][~equal].head().tolist(), b[c][~equal].head().tolist())
