"""Every query that has SQL gives the rows of its SQL."""

import pytest
from oracle import compare, connect

from quire.plans import catalog

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    got = compare(spark, con, QUERIES[name], SQL[name], FOLDER)
    if got == "no rows":  # the smallest tables lack some cases
        got = compare(spark, connect(LARGER), QUERIES[name], SQL[name], LARGER)
    assert got is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
