"""A table that grows by batches: folders of Parquet files and, per batch, one small file that names those that count.

A batch first writes its rows to a folder of their own; nobody reads it before the batch's entry names it, and an entry
is one small file that is there whole or not at all. So a batch is seen whole or not at all on stores that cannot move
folders too. A batch that is tried again finds its entry and changes nothing.

Folders of a table with a key are put together as a binary counter counts: two of one size become one of the next, with the newest
row of each key. After n batches at most about log2(n) folders count, and each row is rewritten at most that often. Without
a key only small folders are put together, until they hold ``SMALL`` bytes; others stay as they were written.
"""

from __future__ import annotations

import json
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.sources.logs import file_system

# Entries that stay readable: a reader that began with an older one may lose its files.
KEPT = 8
# Bytes up to which folders of rows without a key are put together.
SMALL = 8 << 20


def _entries(path: str) -> list[tuple[int, str]]:
    """(batch, file) of every entry, oldest first."""
    system, root = file_system(f"{path}/entries")
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    names = [(info.base_name, info.path) for info in found if info.is_file]
    return sorted((int(name[:-5]), place) for name, place in names if name.endswith(".json") and name[:-5].isdigit())


def _read(path: str, place: str) -> dict:
    system, _ = file_system(path)
    with system.open_input_stream(place) as file:
        return json.loads(file.read())


def newest(path: str) -> dict | None:
    """The last entry: batch, schema, and the folders that count with their size and batches."""
    entries = _entries(path)
    return _read(path, entries[-1][1]) if entries else None


def _put(path: str, batch_id: int, entry: dict) -> None:
    """Writes an entry aside, then gives it its name; only this one small file is ever moved."""
    system, root = file_system(f"{path}/entries")
    system.create_dir(root, recursive=True)
    aside = f"{root}/{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(aside) as file:
        file.write(json.dumps(entry).encode())
    system.move(aside, f"{root}/{batch_id:020d}.json")


def _bytes(path: str, name: str) -> int:
    system, root = file_system(f"{path}/data/{name}")
    return sum(info.size or 0 for info in system.get_file_info(fs.FileSelector(root)))


def committed(path: str, batch_id: int) -> bool:
    last = newest(path)
    return last is not None and last["batch"] >= batch_id


def _latest(rows: DataFrame, key: str) -> DataFrame:
    """The newest row of each key; numbers alone would stay in hash form, whole rows are one value."""
    others = [c for c in rows.columns if c not in (key, "batch")]
    kept = rows.groupBy(key).agg(F.max("batch").alias("batch"), F.max_by(F.struct(*others), "batch").alias("row"))
    return kept.select(key, *[F.col("row")[c].alias(c) for c in others], "batch")


def commit(rows: DataFrame, path: str, batch_id: int, key: str | None = None) -> None:
    """Adds a batch's rows, which replace earlier ones of their ``key`` where one is given.

    Batches come with ascending ids from one writer; one that is in the ledger already is left as it is. A batch without rows is
    a batch. With a key, a batch holds each key once.
    """
    last = newest(path)
    if last is not None and last["batch"] >= batch_id:
        return
    folders = list(last["folders"]) if last else []
    spark = rows.sparkSession

    def write(table: DataFrame) -> str:
        name = f"{batch_id}-{uuid.uuid4().hex}"
        table.write.parquet(f"{path}/data/{name}")
        return name

    stamped = rows.withColumn("batch", F.lit(batch_id).cast("bigint"))
    schema = stamped.schema.json()
    own = write(stamped)
    size, merged, first, held = 0, [], batch_id, 0 if key else _bytes(path, own)
    while folders and folders[-1]["size"] == size and (key or held + folders[-1]["bytes"] <= SMALL):
        taken = folders.pop()
        merged.append(taken["name"])
        size, first, held = size + 1, taken["first"], held + taken["bytes"]
    if merged:
        table = spark.read.schema(stamped.schema).parquet(*[f"{path}/data/{name}" for name in [*merged, own]])
        own = write(_latest(table, key).select(*stamped.columns) if key else table)
    folders.append({"name": own, "size": size, "first": first, "last": batch_id, "bytes": held})
    _put(path, batch_id, {"batch": batch_id, "schema": schema, "folders": folders})
    _tidy(path)


def _tidy(path: str) -> None:
    """Removes entries older than the last ``KEPT`` and the folders that only they, or nobody, name."""
    entries = _entries(path)
    if len(entries) <= KEPT:
        return
    system, root = file_system(f"{path}/data")
    named = {f["name"] for _, place in entries[-KEPT:] for f in _read(path, place)["folders"]}
    for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.base_name not in named:
            system.delete_dir(info.path)
    for _, place in entries[:-KEPT]:
        system.delete_file(place)


def read(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """All rows that count, with the ``batch`` that brought them; of a keyed table a key may come from several folders.

    A ledger without batches has the rows of an empty table of ``schema``, and cannot be read without one.
    """
    last = newest(path)
    if last is None:
        if schema is None:
            raise FileNotFoundError(f"no batches in {path}")
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("bigint"))
    return _rows_in(spark, path, last, last["folders"])


def read_batch(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The rows that count of one batch, without ``batch``; only folders that may hold them are read.

    A batch that is not in the ledger has no rows.
    """
    last = newest(path)
    if last is None:
        raise FileNotFoundError(f"no batches in {path}")
    holding = [f for f in last["folders"] if f["first"] <= batch_id <= f["last"]]
    return _rows_in(spark, path, last, holding).filter(F.col("batch") == batch_id).drop("batch")


def _rows_in(spark: SparkSession, path: str, entry: dict, folders: list[dict]) -> DataFrame:
    kept = T.StructType.fromJson(json.loads(entry["schema"]))
    if not folders:
        return spark.createDataFrame([], kept)
    return spark.read.schema(kept).parquet(*[f"{path}/data/{f['name']}" for f in folders])


def read_latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The newest row of each key, from the few folders that count."""
    return _latest(read(spark, path), key).drop("batch")
