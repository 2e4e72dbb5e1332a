"""Every registered query against its SQL on the driver tables."""

import pytest
from oracle_check import compare, connect

from __spark_entry__ import entry
from bindings.oracle import ORACLE
from bindings.queries import QUERIES
from bindings.views import Views

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, con, name):
    assert compare(QUERIES[name](Views(spark, SF)), con, ORACLE[name]) == []
