"""Every signal query that has SQL equals DuckDB's result on the same tables."""

import collections
import math
import os

import duckdb
import pytest

from pneumaspark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    result = con.execute(catalog.oracle_sql()[name])
    place = [[d[0] for d in result.description].index(c) for c in cols]
    want = collections.Counter(tuple(plain(r[k]) for k in place) for r in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_gives_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
