"""Every registered query against its SQL in DuckDB, on the smallest test tables."""

import os
import re

import pytest

from check_queries import compare, duck, load_entry

SF_DIR = "/root/testdata/sf0.001"
entry = load_entry()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


OWN = [name for name in entry.queries() if not re.match(r"op\d+_|pipeline$", name)]


def test_every_query_has_sql():
    assert set(OWN) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF_DIR) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 8
