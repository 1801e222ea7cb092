"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from clauseworks.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return [norm(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rows = sorted(([norm(v) for v in r] for r in df.select(*columns).collect()), key=repr)
    if name not in registry.ORACLES:
        assert rows
        return
    found = con.execute(registry.ORACLES[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert rows == sorted(([norm(r[i]) for i in at] for r in found.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
