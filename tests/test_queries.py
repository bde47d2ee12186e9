"""Every query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from foliospark.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    assert rows == sorted(repr([plain(v) for v in r]) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())
