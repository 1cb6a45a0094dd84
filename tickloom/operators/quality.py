"""Rules for submitted rows: keep the good, set the bad aside, count reasons."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import clean


def job_rules() -> dict[str, Column]:
    """What a submitted job must satisfy; each column is TRUE for a good row."""
    return {
        "dmemory": clean.is_memory("dmemory"),
        "ememory": clean.is_memory("ememory"),
        "priority": clean.is_priority("priority"),
        "entrypoint": clean.is_entrypoint("entrypoint"),
        "jar": clean.is_jar_path("jar"),
        "status": F.col("status").isin(*clean.JOB_STATUSES),
        "createtime": clean.is_time("createtime"),
        "submittime": clean.is_time("submittime"),
        "options": clean.parse_args("options").isNotNull(),
    }


def timetable_rules() -> dict[str, Column]:
    return {
        "status": F.col("status").isin(*clean.TIMETABLE_STATUSES),
        "createtime": clean.is_time("createtime"),
    }


def address_rules(master: str, ui: str, jdbc: str) -> dict[str, Column]:
    """Rules for columns holding cluster and database addresses."""
    return {
        "master_url": clean.is_master_url(master),
        "ui_url": clean.is_ui_url(ui),
        "jdbc_url": clean.is_jdbc_url(jdbc),
    }


def tag_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Adds ``violations``: names of the rules a row breaks; NULL breaks a rule."""
    broken = [
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()
    ]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def validate(
    df: DataFrame, rules: Mapping[str, Column]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(valid rows, rows set aside with ``violations``, counts per broken rule)."""
    tagged = tag_violations(df, rules)
    bad = tagged.filter(F.size("violations") > 0)
    counts = (
        bad.select(F.explode("violations").alias("rule"))
        .groupBy("rule")
        .agg(F.count("*").alias("rows"))
    )
    return tagged.filter(F.size("violations") == 0).drop("violations"), bad, counts
