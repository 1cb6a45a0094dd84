"""The four stored tables, and job documents as JSON."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.records import to_documents


LONG, TEXT = T.LongType(), T.StringType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SCHEMAS = {
    "job": _schema(
        uid=LONG, name=TEXT, status=TEXT, createtime=LONG, submittime=LONG, starttime=LONG,
        finishtime=LONG, priority=LONG, sparkappid=TEXT, entrypoint=TEXT, jar=TEXT,
        options=T.MapType(TEXT, TEXT), jobconf=T.ArrayType(TEXT),
    ),
    "timetable": _schema(
        uid=LONG, name=TEXT, status=TEXT, createtime=LONG, canceltime=LONG, cron=TEXT, job_uid=LONG
    ),
    "timetable_stats": _schema(timetable_uid=LONG, job_uid=LONG, createtime=LONG),
    "template": _schema(uid=LONG, name=TEXT, createtime=LONG, content=TEXT),
}

# Column that splits a table into parallel database reads.
_SPLIT_BY = {"job": "uid", "timetable": "uid", "timetable_stats": "timetable_uid", "template": "uid"}


def decode_jobs(jobs: DataFrame) -> DataFrame:
    """options and jobconf from JSON text, where a store keeps them as such."""
    kinds = {name: SCHEMAS["job"][name].dataType for name in ("options", "jobconf")}
    for name, kind in kinds.items():
        if jobs.schema[name].dataType == TEXT:
            jobs = jobs.withColumn(name, F.from_json(name, kind))
    return jobs


def bounds_query(table: str) -> str:
    """The query a database answers with the range of the table's split key."""
    key = _SPLIT_BY[table]
    return f"SELECT MIN({key}) AS low, MAX({key}) AS high FROM {table}"


def jdbc_options(
    url: str, table: str, parts: int, bounds: tuple[int | None, int | None], **extra: str
) -> dict[str, str]:
    """Options of one table read by up to ``parts`` connections over the key range ``bounds``.

    The range only spreads the rows: keys outside it are read as well. Where it is empty, as
    for an empty table or one without keys, one connection reads all.
    """
    low, high = bounds
    whole = {"url": url, "dbtable": table, **extra}
    if low is None or high is None:
        return whole
    return {
        **whole,
        "partitionColumn": _SPLIT_BY[table],
        "lowerBound": str(low),
        "upperBound": str(high + 1),  # the last part starts below it
        "numPartitions": str(max(1, min(parts, high - low + 1))),
    }


def key_bounds(spark: SparkSession, url: str, table: str, **extra: str) -> tuple[int | None, int | None]:
    """Smallest and largest split key of a table, found by the database itself."""
    options = {"url": url, "query": bounds_query(table), **extra}
    low, high = spark.read.format("jdbc").options(**options).load().first()
    return (None, None) if low is None else (int(low), int(high))


def read_tables(
    spark: SparkSession,
    location: str,
    parts: int = 64,
    bounds: Mapping[str, tuple[int | None, int | None]] | None = None,
    names: Iterable[str] = tuple(SCHEMAS),
    **extra: str,
) -> dict[str, DataFrame]:
    """The stored tables by name, from a folder of Parquet tables or a ``jdbc:`` address.

    A database is asked for the range of each table's key unless ``bounds`` gives it.
    """
    tables = {}
    for name in names:
        if location.startswith("jdbc:"):
            known = (bounds or {}).get(name) or key_bounds(spark, location, name, **extra)
            options = jdbc_options(location, name, parts, known, **extra)
            tables[name] = spark.read.format("jdbc").options(**options).load()
        else:
            tables[name] = spark.read.schema(SCHEMAS[name]).parquet(f"{location.rstrip('/')}/{name}")
    if "job" in tables:
        tables["job"] = decode_jobs(tables["job"])
    return tables


def write_metadata(jobs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON document per job, a line each, in a folder per status."""
    documents = to_documents(jobs, "job").select("status", F.col("document").alias("value"))
    documents.write.mode(mode).partitionBy("status").text(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Documents back as rows of the job table."""
    schema = SCHEMAS["job"]
    return spark.read.text(path).select(
        F.from_json("value", schema).alias("job")
    ).select("job.*")
