"""Path columns: plain text, ``/`` between parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def path_parts(path: Column | str) -> Column:
    """Names from the root down; NULL for a path with an empty part."""
    parts = F.split(F.regexp_replace(_col(path), "^/", ""), "/")
    return F.when(~F.exists(parts, lambda p: p == ""), parts)


def within(path: Column | str, home: str) -> Column:
    """Is the path home itself or below it?"""
    home = home.rstrip("/")
    path = _col(path)
    return (path == (home or "/")) | path.startswith(home + "/")


def extension(name: Column | str) -> Column:
    """Text from the last dot; leading dots belong to the name."""
    return F.regexp_extract(_col(name), r"(?s)^\.*[^.].*(\.[^.]*)$", 1)
