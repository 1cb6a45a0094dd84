"""Readable time spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.clean import floor_div, ms_to_ts


def duration_label(ms: Column) -> Column:
    """``2hrs 5min``, ``5min 3sec`` or ``3sec (3120)``."""
    seconds = floor_div(ms, 1000)
    minutes, hours = floor_div(seconds, 60), floor_div(seconds, 3600)
    return (
        F.when(hours > 0, F.concat(hours, F.lit("hrs "), minutes % 60, F.lit("min")))
        .when(minutes > 0, F.concat(minutes, F.lit("min "), seconds % 60, F.lit("sec")))
        .when(ms.isNotNull(), F.concat(seconds, F.lit("sec ("), ms, F.lit(")")))
    )


def age_label(ms: Column, now_ms: int | Column) -> Column:
    """How long ago, up to a day; otherwise (also in the future) the date and time."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    age = now - ms
    return (
        F.when((age > 0) & (age < 60_000), F.lit("less than a minute ago"))
        .when(age.between(60_000, 3_599_999), F.concat(floor_div(age, 60_000), F.lit(" minutes ago")))
        .when(
            age.between(3_600_000, 86_399_999),
            F.concat(floor_div(age, 3_600_000), F.lit(" hours ago")),
        )
        .otherwise(F.date_format(ms_to_ts(ms), "yyyy-MM-dd HH:mm:ss"))
    )
