"""Each registered query of the core against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from quarry.plans import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="PENDING: no tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*cols).collect())
    if name not in SQL:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    r = con.sql(SQL[name])
    at = [r.columns.index(c) for c in cols]
    assert sorted(r.columns) == cols
    assert got == sorted(repr(tuple(plain(x[i]) for i in at)) for x in r.fetchall())
