"""Every query at sf0.01 against its SQL."""

from __future__ import annotations

import pytest

from compare import connect, differences

import __spark_entry__ as contract
from tickloom.plans.queries import QUERIES
from tickloom.plans.sql import ORACLE

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert contract.entry(spark).columns == ["event_type", "events"]
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    found = differences(contract.queries()[name](spark, SF_DIR), con, contract.oracle_sql()[name])
    assert not found, found
