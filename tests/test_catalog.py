"""Catalog queries against their check SQL on the smallest tables (`oracle_check.py` runs all of them at any size)."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from flowward.plans.catalog import ORACLES
from oracle_check import TESTDATA, compare, connect

SF_DIR = f"{TESTDATA}/sf0.001"
NAMES = sorted(ORACLES)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_check_has_its_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).first()["total"] > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    assert compare(queries()[name](spark, SF_DIR), con, oracle_sql()[name]) is None
