"""A query against its SQL in DuckDB, as bags of rows."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def canonical(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("float"):
            df[c] = df[c].map(lambda v: "null" if v != v else f"{v:.9g}")
        df[c] = df[c].map(str).replace({"None": "null", "<NA>": "null", "NaT": "null", "nan": "null"})
    return sorted(map(tuple, df.itertuples(index=False)))


def same(spark, name, queries, oracles, folder):
    got = queries[name](spark, folder).toPandas()
    want = duck(folder).sql(oracles[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
