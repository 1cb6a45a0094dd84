"""Listings with related rows: run statistics, enrichment, templates, documents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.clean import json_or_else
from tickloom.functions.cron import FIELDS
from tickloom.functions.labels import age_label, duration_label
from tickloom.operators.schedules import parse_schedules

JOB_COLUMNS = (
    "uid", "name", "status", "createtime", "submittime", "starttime", "finishtime",
    "priority", "sparkappid", "entrypoint", "jar", "options", "jobconf",
)

# The fields a template stores.
TEMPLATE_FIELDS = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "name", "entrypoint", "dmemory", "ememory", "options", "jobconf", "delay", "jar",
        )
    ]
)


def run_totals(stats: DataFrame) -> DataFrame:
    """Per timetable: jobs, last_time, last_job_uid (the larger uid on equal times, NULL only if it is NULL in all of those)."""
    return (
        stats.groupBy("timetable_uid")
        .agg(F.count("*").alias("jobs"), F.max("createtime").alias("last_time"),
             F.max(F.struct("createtime", "job_uid")).alias("_newest"))
        .select("timetable_uid", "jobs", "last_time", F.col("_newest.job_uid").alias("last_job_uid"))
    )


def run_stats(timetables: DataFrame, stats: DataFrame) -> DataFrame:
    """Every timetable with its run totals; 0 and NULLs where it never ran."""
    totals = run_totals(stats).withColumnRenamed("timetable_uid", "uid")
    return timetables.join(totals, "uid", "left").withColumn(
        "jobs", F.coalesce("jobs", F.lit(0).cast("bigint"))
    )


def enrich_timetables(timetables: DataFrame, jobs: DataFrame) -> DataFrame:
    """Adds ``job``, the template job's record, NULL if there is none."""
    fields = [c for c in JOB_COLUMNS if c in jobs.columns]
    record = jobs.select(F.col("uid").alias("job_uid"), F.struct(*fields).alias("job"))
    return timetables.join(record, "job_uid", "left")


def elapsed(df: DataFrame, now_ms: int | None = None) -> DataFrame:
    """Adds ``elapsed_ms`` and ``elapsed_label``, and ``age`` of createtime if now is given."""
    ms = F.col("finishtime") - F.col("starttime")
    df = df.withColumn("elapsed_ms", ms).withColumn("elapsed_label", duration_label(ms))
    return df if now_ms is None else df.withColumn("age", age_label(F.col("createtime"), now_ms))


def expand_templates(templates: DataFrame) -> DataFrame:
    """Adds the stored job fields as columns ``job_<field>``, and ``fields``, a map of all keys; NULL where unreadable.

    A value that is no text stands in ``fields`` as its JSON.
    """
    parsed = templates.withColumn("_fields", json_or_else("content", TEMPLATE_FIELDS))
    named = {f"job_{f.name}": F.col("_fields")[f.name] for f in TEMPLATE_FIELDS}
    every = F.when(F.col("_fields").isNotNull(), json_or_else("content", T.MapType(T.StringType(), T.StringType())))
    return parsed.withColumns({**named, "fields": every}).drop("_fields")


def action_flags(kind: str, status: Column | None = None) -> dict:
    """What the status allows, as booleans by name."""
    status = F.col("status") if status is None else status
    if kind == "job":
        return {"can_close": status.isin("READY", "DELAYED")}
    if kind == "timetable":
        return {
            "can_pause": status == "ACTIVE",
            "can_resume": status == "PAUSED",
            "can_cancel": status != "CANCELLED",
        }
    if kind == "template":
        return {}
    raise ValueError(f"unknown kind of record: {kind!r}")


def _members(parts: list[tuple[str, Column, bool]]) -> Column:
    """One JSON object of (name, value, whether the value is JSON text already); neighbours that are not are written together."""
    pieces, typed = [], []

    def written() -> None:
        if typed:
            text = F.to_json(F.struct(*[value.alias(name) for name, value in typed]), {"ignoreNullFields": "false"})
            pieces.append(F.substring(text, F.lit(2), F.length(text) - 2))
            typed.clear()

    for name, value, is_text in parts:
        if is_text:
            written()
            pieces.append(F.concat(F.lit(json.dumps(name) + ":"), F.coalesce(value, F.lit("null"))))
        else:
            typed.append((name, value))
    written()
    return F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}"))


def _rule_text() -> Column:
    """A parsed rule as JSON: its text and the values of each field, a number where the field names one value alone."""
    words = F.regexp_extract_all(F.trim("cron"), F.lit(r"\S+"), F.lit(0))
    parts = [("pattern", F.col("cron"), False)]
    for i, f in enumerate(FIELDS):
        values = F.col(f"{f.name}_values")
        alone = F.get(words, F.lit(i)).rlike("^[0-9A-Za-z]+$")
        parts.append((f.name, F.when(alone, F.get(values, F.lit(0)).cast("string")).otherwise(F.to_json(values)), True))
    return _members(parts)


def to_documents(df: DataFrame, kind: str) -> DataFrame:
    """(uid, status, document): one JSON text per row, NULL fields kept.

    A timetable's rule becomes an object of its text and the values of each field: NULL
    for any, a number for a field that names one value alone, else a list. Documents of timetables want the columns of
    :func:`run_stats` and :func:`enrich_timetables`; those present are nested under ``stats`` and as ``job``, which has the flags
    of jobs where it has a status. A template's stored JSON stands as it is, with all its keys; what is not JSON as a whole is NULL.
    """
    flags, nested = action_flags(kind), []
    replaced: dict[str, tuple[Column, bool]] = {}
    if kind == "timetable":
        nested = [c for c in ("jobs", "last_time", "last_job_uid") if c in df.columns]
        if "job" in df.columns and isinstance(df.schema["job"].dataType, T.StructType):
            record = df.schema["job"].dataType.names
            own = [flag.alias(name) for name, flag in action_flags("job", F.col("job")["status"]).items()] if "status" in record else []
            whole = F.struct(*[F.col("job")[c].alias(c) for c in record], *own)
            replaced["job"] = (F.when(F.col("job").isNotNull(), whole), False)
        if "cron" in df.columns:
            # few rules are shared by many rows: each is parsed once
            rules = parse_schedules(df.select("cron").distinct()).select(F.col("cron").alias("_rule"), _rule_text().alias("_parsed"))
            df = df.join(rules, F.col("cron").eqNullSafe(F.col("_rule")), "left")
            replaced["cron"] = (F.col("_parsed"), True)
    if kind == "template" and "content" in df.columns:
        replaced["content"] = (F.when(json_or_else("content", TEMPLATE_FIELDS).isNotNull(), F.trim("content")), True)
    columns = [c for c in df.columns if c not in nested and not (c in ("_rule", "_parsed") and "cron" in replaced)]
    parts = [(c, *replaced.get(c, (F.col(c), False))) for c in columns]
    if nested:
        parts.append(("stats", F.struct(*nested), False))
    parts += [(name, flag, False) for name, flag in flags.items()]
    status = F.col("status") if "status" in columns else F.lit(None).cast("string")
    return df.select("uid", status.alias("status"), _members(parts).alias("document"))
