"""Every query against its SQL; those without SQL must at least run."""

import pytest

from stateglass.plans import ORACLES, QUERIES
from tests.check import compare, oracle_connection

NO_SQL = sorted(set(QUERIES) - set(ORACLES))


@pytest.fixture(scope="module")
def connection(sf_dir):
    return oracle_connection(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf_dir, connection):
    assert compare(spark, connection, sf_dir, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", NO_SQL)
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0
