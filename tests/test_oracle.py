"""Every registered query next to its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from check_sql import TABLES, rows_of

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        cur = con.execute(SQL[name])
        assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
