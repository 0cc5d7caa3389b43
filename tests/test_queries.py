"""Every registered query of the record operators against its DuckDB SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from loomwell.plans import registry

SF = os.environ.get("LOOMWELL_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    columns, rows = sorted(got.columns), got.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in found.fetchall())
    assert sorted(tuple(plain(row[c]) for c in columns) for row in rows) == want
