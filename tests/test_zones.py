"""Matching follows the wall clock of the session's zone, also on the days it changes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tickloom.operators import schedules

TIMES = ["2024-03-10 01:30:59.5", "2024-03-10 02:30:00", "2024-03-10 03:30:00", "2024-11-03 00:59:59", "2024-11-03 01:30:00", "2024-11-03 02:30:00"]


@pytest.fixture
def new_york(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_wall_clock_times(new_york):
    events = new_york.createDataFrame([(n, t) for n, t in enumerate(TIMES)], "n bigint, t string").select(
        "n", F.col("t").cast("timestamp_ntz").alias("ts"))
    hours = [1, 2, 3, 0, 1, 2]
    rules = [(h, "r", "ACTIVE", f"* {h} * * * *", 1) for h in range(4)]
    timetables = new_york.createDataFrame(rules, "uid bigint, name string, status string, cron string, job_uid bigint")
    got = sorted((r.n, r.timetable_uid) for r in schedules.match_schedules(events, timetables).collect())
    assert got == list(enumerate(hours))
    for h in range(4):
        direct = [r.n for r in schedules.cron_filter(events, "ts", f"* {h} * * * *").collect()]
        assert sorted(direct) == [n for n, x in enumerate(hours) if x == h]
    minutes = [str(r[0]) for r in events.orderBy("n").select(schedules.to_minute(F.col("ts"))).collect()]
    assert minutes == [t[:16] + ":00" for t in TIMES]


def test_instants(new_york):
    """Instants are matched by what the clock shows; an hour that comes twice counts twice."""
    events = new_york.sql("SELECT id AS n, timestamp_seconds(1730608200 + id * 3600) AS ts FROM range(3)")  # 00:30, 01:30, 01:30
    timetables = new_york.createDataFrame([(1, "r", "ACTIVE", "30 1 * * * *", 1)],
                                          "uid bigint, name string, status string, cron string, job_uid bigint")
    assert sorted(r.n for r in schedules.match_schedules(events, timetables).collect()) == [1, 2]
