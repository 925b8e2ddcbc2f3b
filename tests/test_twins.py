"""Every query with a SQL twin gives the same table in both engines."""

import duckdb
import pytest

import __spark_entry__ as entry
import check

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(name, spark, small, db):
    out = QUERIES[name](spark, small)
    mine = check.table_rows(out.columns, out.collect())
    cursor = db.execute(SQL[name])
    theirs = check.table_rows([c[0] for c in cursor.description], cursor.fetchall())
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).count() == 5
