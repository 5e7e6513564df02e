"""Every registered engine query against its SQL, over the smallest tables."""

import math
import os

import duckdb
import pytest

from docframe import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def plain(rows):
    value = lambda v: "~" if v is None or isinstance(v, float) and math.isnan(v) else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(value, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF), con.sql(catalog.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got.select(*columns).collect()) == plain(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_entry_point():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.QUERIES) <= set(e.queries())
