"""Every registered query beside its SQL twin on the smallest tables."""

import pytest

from oracle import compare, connect
from spanloom.plans import load_all
from spanloom.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, con, key):
    diff, n = compare(spark, con, SF, key, QUERIES[key], ORACLE.get(key))
    assert diff is None, diff
