"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from repoatlas.plans.registry import ORACLE, QUERIES
from tests.compare import difference, duck
from tests.conftest import SMALL

@pytest.fixture(scope="module")
def connection():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, connection, name):
    assert difference(entry.queries()[name](spark, SMALL), connection, entry.oracle_sql()[name]) is None


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
