"""Comparison of a query's rows with those of its SQL."""

from __future__ import annotations

import glob
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        files = sorted(glob.glob(f"{path}/**/*.parquet", recursive=True)) if os.path.isdir(path) else [path]
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files})")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v if v is None or isinstance(v, bool | int) else str(v)


def same(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    types = {x[0]: str(x[1]) for x in result.description}
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == types
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert got == want
