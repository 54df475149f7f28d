"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest
from compare import connect, difference

from marginalia.queries import all_queries
from marginalia.queries.oracle import oracle_queries

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SQL = oracle_queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(all_queries()) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    assert difference(all_queries()[name](spark, SF).toPandas(), con.execute(SQL[name]).df()) is None
