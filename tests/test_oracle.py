"""Every query against its SQL in a second engine, on whole tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

from __spark_entry__ import entry, oracle_sql, queries
from compare import difference, duck


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", list(queries()))
def test_query_agrees_with_sql(spark, con, folder, name):
    assert difference(spark, con, folder, name) is None


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    assert entry(spark).count() == 25
