"""Job logs: folders ``job-<uid>`` with ``stdout`` and ``stderr``."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.logs import LOG_CHUNK, LOG_WINDOW, pages_of
from tickloom.operators.spread import spread

# Neighbouring pages read by one task, so a file is opened once per run of pages.
_RUN = 64
# Page bytes and rows a task gathers before it sends them to Spark.
_HELD, _HELD_ROWS = 4 << 20, 4096


def _jobs_in(path: str):
    """The jobs whose folder stands in ``path``, as one task lists it."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                system, root = file_system(path)
                names = [info.base_name for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True))]
                uids = [int(name[4:]) for name in names if re.fullmatch(r"job-[0-9]{1,18}", name)]
                yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64())], ["uid"])

    return listed


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, uid, type, length) of all log files; empty ones too, which Spark's own listing passes over.

    Schemes are those of pyarrow's file systems: local files, hdfs, s3, gs.
    """
    return _files_of(_logs_of(spark.range(1).mapInArrow(_jobs_in(path), "uid bigint")), path)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Many short logs make one batch; a batch a log would cost more than most logs."""
    rows, held = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            if rows and held + row["length"] > _HELD:  # a long log is alone
                yield pa.RecordBatch.from_pylist(rows, schema=_WHOLE)
                rows, held = [], 0
            with _open(row["path"]) as file:
                content = file.read()
            rows.append({**{k: row[k] for k in ("uid", "type")}, "length": len(content), "content": content})
            held += len(content)
            if held >= _HELD or len(rows) >= _HELD_ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=_WHOLE)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_WHOLE)


_WHOLE = pa.schema([("uid", pa.int64()), ("type", pa.string()), ("length", pa.int64()), ("content", pa.binary())])


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(uid, type, length, content): whole logs, for files of up to 2 GB each; an empty file has empty content."""
    return _files(spark, path).mapInArrow(_contents, "uid bigint, type string, length bigint, content binary")


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    local = re.match(r"^(?:file:)?/+(.*)$", uri)
    if local:
        return fs.LocalFileSystem(), "/" + local[1]
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def _open(uri: str):
    system, path = file_system(uri)
    return system.open_input_file(path)


def _line_window(data: bytes, before: bool) -> bytes:
    at = data.find(b"\n")
    if at < 0:
        return data
    return data[at + 1 :] if before else data[:at]


def _read_pages(chunk: int, window: int, origin: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        rows, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] is not None and row["path"] != name:
                    if file is not None:
                        file.close()
                    name, file = row["path"], _open(row["path"])
                size, page = row["length"] or 0, row["page"] or 0
                start = (page - 1) * chunk if origin == "start" else size - page * chunk

                def piece(low: int, high: int) -> bytes:
                    low, high = max(low, 0), min(high, size)
                    return file.read_at(high - low, low) if high > low else b""

                block = piece(start, start + chunk) if row["path"] is not None else None
                if block and window > 0:
                    block = (
                        _line_window(piece(start - window, start), True)
                        + block
                        + _line_window(piece(start + chunk, start + chunk + window), False)
                    )
                rows.append({**{k: row[k] for k in _PAGE.names[:-1]}, "block": block})
                held += len(block or b"")
                if held >= _HELD or len(rows) >= _HELD_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=_PAGE)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_PAGE)
        if file is not None:
            file.close()

    return read


_PAGE = pa.schema(
    [("uid", pa.int64()), ("type", pa.string()), ("page", pa.int64()),
     ("page_count", pa.int64()), ("block", pa.binary())]
)


_FILE = pa.schema(
    [("path", pa.string()), ("uid", pa.int64()), ("type", pa.string()), ("length", pa.int64())]
)


def _stat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            system, path = file_system(row["path"])
            info = system.get_file_info(path)
            if info.type == fs.FileType.File:
                found.append({**row, "length": info.size})
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=_FILE)


def _logs_of(jobs: DataFrame) -> DataFrame:
    """(uid, type) of the logs the jobs may have."""
    return jobs.select(F.col("uid").cast("bigint"), F.explode(F.array(F.lit("stdout"), F.lit("stderr"))).alias("type"))


def _files_of(named: DataFrame, path: str) -> DataFrame:
    """The files there are of the logs (uid, type) named, looked up by name in the tasks."""
    name = F.concat(F.lit(f"{path.rstrip('/')}/job-"), "uid", F.lit("/"), "type")
    names = named.filter(F.col("uid").isNotNull() & F.col("type").isin("stdout", "stderr")).select(name.alias("path"), "uid", "type")
    return spread(names, "path").mapInArrow(
        _stat, "path string, uid bigint, type string, length bigint"
    )


def read_log_pages(
    spark: SparkSession,
    path: str,
    chunk: int = LOG_CHUNK,
    offset: int = LOG_WINDOW,
    jobs: DataFrame | None = None,
    origin: str = "start",
    requests: DataFrame | None = None,
) -> DataFrame:
    """(uid, type, page, page_count, block) of logs, pages counted from the start or from the end.

    Tasks know names and sizes only and seek to their own pages. So a log of any size
    is read by many tasks at once and never held whole, as it is by :func:`read_logs`
    followed by ``paginate``, which gives the same pages.

    An empty log gives one empty page. With ``requests`` (uid, type, page) only those pages are read, each once;
    the block is NULL where a log has no such page, the count too where there is no log. With ``jobs`` (column uid) their logs are looked up by
    name, without listing the folder.
    """
    if origin not in ("start", "end"):
        raise ValueError("origin is 'start' or 'end'")
    if requests is not None:
        asked = requests.select(F.col("uid").cast("bigint"), "type", F.col("page").cast("bigint")).distinct()
        files = _files_of(asked.select("uid", "type").distinct(), path)
    elif jobs is not None:
        files = _files_of(_logs_of(jobs), path)
    else:
        files = _files(spark, path)
    files = files.select("path", "uid", "type", "length", pages_of(F.col("length"), chunk).alias("page_count"))
    if requests is None:
        pages = files.withColumn("page", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("page_count"))))
    else:
        # a page that is not there goes along without a path, so logs are looked up once for both kinds
        there = F.col("page").between(F.lit(1), F.col("page_count"))
        pages = asked.join(files, ["uid", "type"], "left").withColumn("path", F.when(there, F.col("path")))
    runs = pages.withColumn("run", F.call_function("div", F.col("page"), F.lit(_RUN).cast("bigint")))
    # a row of a page is short and its reading long: tasks are not merged by row size
    return spread(runs, "uid", "type", "run").sortWithinPartitions("path", "page").mapInArrow(
        _read_pages(chunk, offset, origin),
        "uid bigint, type string, page bigint, page_count bigint, block binary",
    )
