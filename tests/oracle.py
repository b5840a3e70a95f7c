"""Compare a query with its SQL, row by row, whatever the order."""

import math
import os
from collections import Counter
from pathlib import Path

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same(spark, query, sql, folder=FOLDER):
    import duckdb

    c = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = query(spark, folder)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(v) for v in r) for r in df.select(columns).collect())
    rel = c.sql(sql)
    at = {n: k for k, n in enumerate(rel.columns)}
    assert sorted(at) == columns
    want = Counter(tuple(plain(r[at[c]]) for c in columns) for r in rel.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
