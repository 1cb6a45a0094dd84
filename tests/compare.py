"""Side-by-side comparison of a query and its SQL, strict on names, types and values."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

SAME_TYPE = {
    "bigint": {"BIGINT"}, "int": {"INTEGER"}, "string": {"VARCHAR", '"NULL"'}, "boolean": {"BOOLEAN"},
    "double": {"DOUBLE"}, "timestamp_ntz": {"TIMESTAMP"}, "binary": {"BLOB"},
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _ordered(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty if the results agree."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    expected = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    found = []
    for column, kind in df.dtypes:
        if kinds[column] not in SAME_TYPE.get(kind, {kind}):
            found.append(f"type of {column}: {kind} != {kinds[column]}")
    order = sorted(names)
    place = [names.index(c) for c in order]
    theirs = _ordered([tuple(row[i] for i in place) for row in expected])
    ours = _ordered([tuple(row[c] for c in order) for row in df.collect()])
    if len(ours) != len(theirs):
        found.append(f"rows: {len(ours)} != {len(theirs)}")
    for a, b in zip(ours, theirs):
        if any(not _same(x, y) for x, y in zip(a, b)):
            found.append(f"{order}: {str(a)[:600]} != {str(b)[:600]}")
            break
    return found


def _same(x, y) -> bool:
    if isinstance(x, float) and isinstance(y, float):
        return math.isclose(x, y, rel_tol=1e-9)
    return x == y
