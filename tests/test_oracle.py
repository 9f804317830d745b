"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from landmosaic.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events embeddings labels".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    rows = df.collect()
    if name not in registry.oracle_sql():
        assert df.columns
        return
    found = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda rs: sorted((tuple(plain(v) for v in r) for r in rs), key=repr)
    assert key([tuple(r[c] for c in names) for r in rows]) == key(found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
