"""Queries that SQL can express, side by side with it."""

from __future__ import annotations

import pytest
from compare import connect, differences

from tickloom.llm.queries import QUERIES
from tickloom.llm.sql import ORACLE

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    found = differences(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLE[name])
    assert not found, found


def test_all_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, len(QUERIES) + 1))
