"""Every registered query equals its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from termwright import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("conversations", "documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    found = registry.queries()[name](spark, SF)
    names = sorted(found.columns)
    ours = sorted(repr([plain(v) for v in r]) for r in found.select(*names).collect())
    result = duck.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in result.description]
    assert sorted(cols) == names
    order = [cols.index(n) for n in names]
    theirs = sorted(repr([plain(r[i]) for i in order]) for r in result.fetchall())
    assert ours == theirs


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
