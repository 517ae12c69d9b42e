"""Every query of the catalogue against its SQL; those without are held against brute force in their own tests."""

import pytest

from locusframe.queries import ORACLES, QUERIES

from .oracle import database, difference


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_those_of_the_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    assert difference(df, con, ORACLES[name]) is None
