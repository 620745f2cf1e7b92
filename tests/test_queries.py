"""Every registered query against its check SQL on the smallest data."""

import pytest

from fleetlens.plans import registry
from tests.oracle import DATA, compare, connect

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, FOLDER)
    assert ok, note


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1500
    assert set(entry.oracle_sql()) <= set(entry.queries())
