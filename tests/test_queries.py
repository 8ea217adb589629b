"""Every registered query with SQL against DuckDB, over whole small tables."""

import math
import os

import duckdb
import pytest

from weftlake.plans import catalogue

DIR = os.environ.get("SMALL_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8)
    return v


def table(cols, data):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return [cols[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    got = table(df.columns, df.collect())
    if name in catalogue.SQL:
        cur = duck.execute(catalogue.SQL[name])
        assert got == table([c[0] for c in cur.description], cur.fetchall())
    else:
        assert got[1]
