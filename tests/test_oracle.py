"""Every registered query against its SQL twin; queries without one must run and give rows."""

import pytest

import __spark_entry__ as contract
from compare import connect, rows_of

QUERIES = contract.queries()
SQL = contract.oracle_sql()
SLOW = {"dataset_single"}  # covered by test_datasets


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(SQL)))
def test_same_rows(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cur = con.execute(SQL[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    got = rows_of(df.columns, df.collect())
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 1 and rows[0].matched > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
