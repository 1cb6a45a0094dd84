"""Whole tables of calendar rules: parse, match, expand, spawn."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.clean import exact_ms
from tickloom.functions.cron import (
    DAY, FIELDS, HOUR, MINUTE, MONTH, WEEKDAY, YEAR, Field,
    allowed_values, cron_match, cron_word, cron_words, in_mask, listed_values, value_mask,
)
from tickloom.operators.spread import TILE, spread, tiled_join


def parse_schedules(df: DataFrame, cron_col: str = "cron") -> DataFrame:
    """Adds ``valid``, ``error``, ``<field>_values`` (NULL for ``*``) and ``<field>_mask``.

    A field that cannot be read has no values and an empty mask, so a bad rule names no
    minute. The operators below rely on that instead of filtering on ``valid``: the
    optimizer would move such a filter down and repeat the parsing in it.
    """
    words = {f: f"_word_{f.name}" for f in FIELDS}
    lists = {f: f"_list_{f.name}" for f in FIELDS}
    values = {f: f"{f.name}_values" for f in FIELDS}
    # one step at a time, since each result is named often in the next
    parsed = (
        df.withColumn("_words", cron_words(F.col(cron_col)))
        .withColumns({words[f]: cron_word("_words", i) for i, f in enumerate(FIELDS)})
        .withColumns({lists[f]: listed_values(words[f], f) for f in FIELDS})
        .withColumns({values[f]: allowed_values(words[f], lists[f], f) for f in FIELDS})
    )
    count = F.size("_words")
    error = F.when(F.col(cron_col).isNull(), F.lit("no rule")).when(
        count != len(FIELDS), F.concat(F.lit("fields: "), count)
    )
    for f in FIELDS:
        error = error.when(F.size(values[f]) == 0, F.lit(f"bad {f.name}"))
    masks = {f"{f.name}_mask": value_mask(values[f], f) for f in FIELDS}
    return (
        parsed.withColumns({"error": error, **masks})
        .withColumn("valid", F.col("error").isNull())
        .drop("_words", *words.values(), *lists.values())
    )


def cron_filter(df: DataFrame, ts_col: str, pattern: str) -> DataFrame:
    """Rows whose timestamp matches one rule; batch or stream."""
    return df.filter(cron_match(F.col(ts_col), pattern))


def _day_matches(day: Column) -> Column:
    tests = [in_mask(f"{f.name}_mask", f.of(day), f) for f in (YEAR, MONTH, DAY, WEEKDAY)]
    return reduce(lambda a, b: a & b, tests)


def _allowed(field: Field) -> Column:
    """Values of the field a parsed rule allows, written out for ``*``."""
    return F.coalesce(f"{field.name}_values", F.sequence(F.lit(field.low), F.lit(field.high)))


def active(timetables: DataFrame) -> DataFrame:
    return timetables.filter(F.col("status") == "ACTIVE")


def _expand(rules: DataFrame, start: datetime, end: datetime, cron_col: str) -> DataFrame:
    """Rows once per whole minute in ``[start, end)`` their rule names, in ``fire_ts``."""
    kept = [c for c in rules.columns if c != cron_col]
    day, hour, minute = F.col("fire_day"), F.col("fire_hour"), F.col("fire_minute")
    days = F.sequence(F.lit(start.date()), F.lit(end.date()))
    fire = F.make_timestamp_ntz(
        F.year(day), F.month(day), F.dayofmonth(day), hour, minute, F.lit(0).cast("decimal(8,6)")
    )
    masks = [f"{f.name}_mask" for f in (YEAR, MONTH, DAY, WEEKDAY)]
    return (
        parse_schedules(rules, cron_col)
        .select(*kept, *masks, "hour_values", "minute_values", F.explode(days).alias("fire_day"))
        .filter(_day_matches(day))
        .select(*kept, "fire_day", "minute_values", F.explode(_allowed(HOUR)).alias("fire_hour"))
        .select(*kept, "fire_day", "fire_hour", F.explode(_allowed(MINUTE)).alias("fire_minute"))
        .select(*kept, fire.alias("fire_ts"))
        .filter((F.col("fire_ts") >= _ntz(start)) & (F.col("fire_ts") < _ntz(end)))
    )


def fire_times(
    schedules: DataFrame, start: datetime, end: datetime, uid_col: str = "uid", cron_col: str = "cron"
) -> DataFrame:
    """(timetable_uid, fire_ts) for each whole minute in ``[start, end)`` that a rule names.

    Every row expands by itself: days that fit, then hours, then minutes. Only the
    short (uid, cron) rows are dealt out beforehand, by uid, so a rule shared by many
    timetables puts no load on one task.
    """
    rules = schedules.select(F.col(uid_col).alias("timetable_uid"), cron_col)
    return _expand(spread(rules, "timetable_uid"), start, end, cron_col)


def _ntz(moment: datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def to_minute(ts: Column) -> Column:
    """The minute of the wall clock a timestamp shows; no detour through an instant, which a change of clocks would move."""
    wall = ts.cast("timestamp_ntz")
    return wall - F.make_dt_interval(secs=F.date_part(F.lit("SECOND"), wall))


def rule_minutes(minutes: DataFrame, schedules: DataFrame, cron_col: str = "cron") -> DataFrame:
    """Distinct rules joined to the rows of ``minutes`` (column ``minute``) they name.

    ``minutes`` holds each minute once. Two equi-joins do the work, so no pass
    compares every rule with every minute: rules meet the distinct days on the
    month, then the surviving (rule, day, hour) meet the minutes on the hour, where
    one bit test is left.
    """
    rules = spread(schedules.select(cron_col).distinct(), cron_col)
    return minutes_of_rules(minutes, parse_schedules(rules, cron_col), cron_col)


def minutes_of_rules(minutes: DataFrame, rules: DataFrame, cron_col: str = "cron") -> DataFrame:
    """:func:`rule_minutes` for rules that are distinct and parsed already.

    Distinct days are few, so they are sent to where the rules are once Spark has measured them; twelve months
    are then not all the keys there are.
    """
    day = F.col("match_day")
    days = (
        minutes.select(F.col("minute").cast("date").alias("match_day"))
        .distinct()
        .withColumn("match_month", F.month(day))
    )
    masks = [f"{f.name}_mask" for f in FIELDS if f is not HOUR]
    rule_days = (
        rules.select(
            cron_col, *masks, "hour_values", F.explode(_allowed(MONTH)).alias("match_month")
        )
        .join(days, "match_month")
        .filter(_day_matches(day))
    )
    rule_hours = rule_days.select(
        cron_col, "minute_mask", day, F.explode(_allowed(HOUR)).alias("match_hour")
    )
    keyed = minutes.withColumns(
        {"match_day": F.col("minute").cast("date"), "match_hour": F.hour("minute")}
    )
    return (
        keyed.join(rule_hours, ["match_day", "match_hour"])
        .filter(in_mask("minute_mask", F.minute("minute"), MINUTE))
        .drop("match_day", "match_hour", "minute_mask")
    )


def due_minutes(
    events: DataFrame, schedules: DataFrame, ts_col: str = "ts", cron_col: str = "cron"
) -> DataFrame:
    """(cron, minute, events): each distinct rule, each minute of the events it names, and their number in it.

    Made from the time column alone. Written and read again it can be given to
    :func:`match_rules` and :func:`match_schedules` as ``due``: Spark then knows its size before
    it reads the events, and where it is small leaves them in place.
    """
    minute = to_minute(F.col(ts_col)).alias("minute")
    minutes = events.filter(F.col(ts_col).isNotNull()).groupBy(minute).agg(F.count("*").alias("events"))
    return rule_minutes(minutes, schedules, cron_col).select(cron_col, "minute", "events")


def match_rules(
    events: DataFrame,
    schedules: DataFrame,
    ts_col: str = "ts",
    cron_col: str = "cron",
    due: DataFrame | None = None,
) -> DataFrame:
    """Events joined to each distinct rule that names their minute.

    As one plan the events are shuffled by minute, since the size of the other side is
    only known once it has been computed; :func:`due_minutes` may be written beforehand.
    """
    if due is None:
        due = due_minutes(events, schedules, ts_col, cron_col)
    keyed = events.withColumn("minute", to_minute(F.col(ts_col)))
    return keyed.join(due.select(cron_col, "minute"), "minute").drop("minute")


def match_schedules(
    events: DataFrame,
    timetables: DataFrame,
    ts_col: str = "ts",
    uid_col: str = "uid",
    cron_col: str = "cron",
    due: DataFrame | None = None,
    most: int = TILE,
) -> DataFrame:
    """Events with each ACTIVE timetable that is due in their minute.

    Events meet the distinct rules first and the timetables of each rule last. How many
    pairs a rule makes is known from the counts of :func:`due_minutes` before any is made, and a rule
    of more than ``most`` pairs is made in many places, so neither a rule that half of the timetables
    share nor a minute with a third of the events is the work of one task. The result has one row per
    pair; use :func:`match_summary` when totals will do.
    """
    tables = active(timetables).select(F.col(uid_col).alias("timetable_uid"), cron_col)
    if due is None:
        due = due_minutes(events, tables, ts_col, cron_col)
    sizes = (
        due.groupBy(cron_col).agg(F.sum("events").alias("lefts"))
        .join(tables.groupBy(cron_col).agg(F.count("*").alias("rights")), cron_col)
    )
    matched = match_rules(events, tables, ts_col, cron_col, due)
    return tiled_join(matched, tables, cron_col, sizes, most).drop(cron_col)


def match_summary(
    events: DataFrame,
    timetables: DataFrame,
    ts_col: str = "ts",
    uid_col: str = "uid",
    cron_col: str = "cron",
) -> DataFrame:
    """Per ACTIVE timetable: number of matching events, first and last of them.

    Events shrink to one row per minute before any join and to one row per rule
    before the timetables join, so neither a busy minute nor a common rule grows
    the work: no event/timetable pair is ever made.
    """
    due = active(timetables).select(F.col(uid_col).alias("timetable_uid"), cron_col)
    ts = F.col(ts_col)
    minutes = (
        events.filter(ts.isNotNull())
        .groupBy(to_minute(ts).alias("minute"))
        .agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    )
    per_rule = (
        rule_minutes(minutes, due, cron_col)
        .groupBy(cron_col)
        .agg(
            F.sum("n").alias("matches"),
            F.min("first").alias("first_ts"),
            F.max("last").alias("last_ts"),
        )
    )
    return due.join(per_rule, cron_col, "left").select(
        "timetable_uid",
        F.coalesce("matches", F.lit(0).cast("bigint")).alias("matches"),
        "first_ts",
        "last_ts",
    )


# Columns a new run takes over from its template job.
_COPIED = ("entrypoint", "jar", "options", "jobconf")


def _with_template(timetables: DataFrame, jobs: DataFrame) -> DataFrame:
    """ACTIVE timetables with the job they copy; those whose job is missing give no run."""
    t = active(timetables).select(
        F.col("uid").alias("timetable_uid"), F.col("name").alias("timetable_name"), "cron", "job_uid"
    )
    return t.join(jobs.select(F.col("uid").alias("job_uid"), *_COPIED), "job_uid")


def _as_runs(fired: DataFrame) -> DataFrame:
    none = F.lit(None).cast("bigint")
    return fired.withColumn("createtime", exact_ms("fire_ts")).select(
        "timetable_uid",
        F.concat("timetable_name", F.lit("-T-"), "createtime").alias("name"),
        F.lit("READY").alias("status"),
        "createtime",
        F.col("createtime").alias("submittime"),
        none.alias("starttime"),
        none.alias("finishtime"),
        F.col("createtime").alias("priority"),
        F.lit(None).cast("string").alias("sparkappid"),
        F.col("job_uid").alias("template_job_uid"),
        *_COPIED,
    )


def spawn_runs(
    fires: DataFrame, timetables: DataFrame, jobs: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """New job rows and run-log rows for the fires of ACTIVE timetables.

    A run has no number of its own: (timetable_uid, createtime) is its key, since a
    timetable fires at most once a minute. The join is asked for as a merge: fires that
    were just expanded from rules look as small to the optimizer as the rules, and must
    not be broadcast on that estimate.
    """
    runs = _as_runs(fires.hint("merge").join(_with_template(timetables, jobs), "timetable_uid"))
    return runs, run_log(runs)


def spawn_due(due: DataFrame, timetables: DataFrame, jobs: DataFrame, most: int = TILE) -> DataFrame:
    """New job rows for a held table ``due`` (cron, minute): each distinct rule with the minutes it fires in.

    The ACTIVE timetables of those rules are picked first, then the jobs those copy, so neither table is shuffled whole
    where Spark sees that the other side is small. They take their job along before they meet the minutes, in tiles of at
    most about ``most`` fires: no fire is ever shuffled, and a rule that many share is the work of many tasks.
    """
    minutes = due.groupBy("cron").agg(F.count("*").alias("rights"))
    firing = timetables.join(minutes.select("cron"), "cron", "left_semi")
    copied = jobs.join(active(firing).select(F.col("job_uid").alias("uid")).distinct(), "uid", "left_semi")
    sizes = active(timetables).groupBy("cron").agg(F.count("*").alias("lefts")).join(minutes, "cron")
    fires = due.select("cron", F.col("minute").alias("fire_ts"))
    return _as_runs(tiled_join(_with_template(firing, copied), fires, "cron", sizes, most))


def planned_runs(
    timetables: DataFrame, jobs: DataFrame, start: datetime, end: datetime
) -> tuple[DataFrame, DataFrame]:
    """``spawn_runs`` for all fires in ``[start, end)``, without a join of fires.

    Timetables take their job along first and expand afterwards, so what is shuffled
    is the timetables, not their many fires.
    """
    due = spread(_with_template(timetables, jobs), "timetable_uid")
    runs = _as_runs(_expand(due, start, end, "cron"))
    return runs, run_log(runs)


def run_log(runs: DataFrame) -> DataFrame:
    """The run-log row of each new job."""
    return runs.select("timetable_uid", F.col("name").alias("job_name"), "createtime")
