"""Every registered query against its SQL on the same tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

from modelshift.plans.registry import ORACLE as SQL
from modelshift.plans.registry import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir).toArrow()
    assert compare(got, con.sql(SQL[name]).to_arrow_table()) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
