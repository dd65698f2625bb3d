import pytest

from provenmark.plans import registry

from .oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, con, name):
    """Queries without SQL have tests of their own in test_brute.py."""
    assert compare(spark, con, FOLDER, registry.queries()[name], registry.oracle_sql()[name]) is None
