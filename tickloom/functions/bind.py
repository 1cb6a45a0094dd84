"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once and held, however often it is named.

    Inside array functions a column is fetched anew at each mention, which for
    binary columns copies it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
