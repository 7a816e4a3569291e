"""Every registered query against its SQL twin on the smallest tables."""
import pytest
from conftest import SF

import __spark_entry__ as entry
from check import compare, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_twins_name_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 3


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF, name)
    assert ok, note
