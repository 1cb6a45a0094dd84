"""Calendar rules: golden cases, and random rules against a plain oracle."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.functions.cron import compile_rule, cron_match
from tickloom.operators import schedules as S
from tickloom.operators.spread import tiled_join

SPANS = {"minute": (0, 59), "hour": (0, 23), "day": (1, 31), "month": (1, 12), "weekday": (1, 7),
         "year": (2014, 2031)}

GOOD = [
    "* * * * * *",
    "0 9 1 * 1 2015",
    "59 23 31 DEC Fri *",
    "0 0,12 1 */2 * *",
    "*/15 */6 1,15,31 * 1-5 *",
    "0 12 * * Mon-Fri *",
    "*/100 * * * * *",
    "*/+5 007 1,1 * * 2014-2031",
    "* * * JAN,2,mar SUN,1 *",
]
BAD = [
    "* * * * *", "* 1,2,3-10 * * * *", "* * 0-10 * * 2015", "* * 1-31 Jan-Tes * 2015", "t b 11 9 * 2015",
    "123", "", "0-30/5 * * * * *", "*/-5 * * * * *", "*/0 * * * * *", "* * */40 * * *", "* 5-1 * * * *",
    "* * * 1-FEB * *", "60 * * * * *", "* 24 * * * *", "* * * * 0 *", "* * * * * 2013", "* * * * * 2032",
    "1, * * * * *", "-5 * * * * *", "1-2-3 * * * * *", "*/a * * * * *", "JAN * * * * *", "* * * * * * *",
    "*,1 * * * * *", "5/5 * * * * *", "*/1/2 * * * * *", "99999999999999999999 * * * * *",
]


def test_compile_good_rules():
    assert compile_rule("59 23 31 DEC Fri *") == compile_rule("59 23 31 12 5 *")
    spelled = "0,15,30,45 0,6,12,18 1,15,31 * 1-5 *"
    assert compile_rule("*/15 */6 1,15,31 * 1-5 *") == compile_rule(spelled)
    assert compile_rule("0 0,12 1 */2 * *")["month"] == (2, 4, 6, 8, 10, 12)
    assert compile_rule("*/100 * * * * *")["minute"] == (0,)
    for rule in GOOD:
        compile_rule(rule)


@pytest.mark.parametrize("rule", BAD)
def test_compile_bad_rules(rule):
    with pytest.raises(ValueError):
        compile_rule(rule)


def random_rule(rng: random.Random) -> str:
    def word(name: str) -> str:
        low, high = SPANS[name]
        names = {"month": ["JAN", "feb", "Dec", "Tes"], "weekday": ["MON", "sun", "Wed"]}.get(name, ["x"])

        def value() -> str:
            return rng.choice(names) if rng.random() < 0.1 else str(rng.randint(low - 1, high + 1))

        return rng.choice([
            lambda: "*", lambda: "*", lambda: value(), lambda: ",".join(value() for _ in range(rng.randint(2, 4))),
            lambda: f"{value()}-{value()}", lambda: f"*/{rng.randint(0, high + 2)}",
            lambda: f"*/+{rng.randint(1, 9)}", lambda: f"{value()}-{value()}/{value()}",
        ])()

    count = 6 if rng.random() < 0.95 else rng.choice([5, 7])
    words = [word(list(SPANS)[i % 6]) for i in range(count)]
    return rng.choice(["", " "]) + rng.choice([" ", "  ", "\t"]).join(words)


def test_column_reader_agrees_with_driver_reader(spark):
    rng = random.Random(7)
    rules = GOOD + BAD + [random_rule(rng) for _ in range(3000)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rules)], "uid bigint, cron string")
    for row in S.parse_schedules(df).collect():
        try:
            want = compile_rule(row.cron)
        except ValueError:
            assert not row.valid and row.error, row.cron
            continue
        assert row.valid and row.error is None, row.cron
        for name, values in want.items():
            assert row[f"{name}_values"] == (None if values is None else list(values)), row.cron
            base = 2014 if name == "year" else 0
            mask = -1 if values is None else sum(1 << (v - base) for v in values)
            assert row[f"{name}_mask"] == mask, row.cron


def test_null_rule(spark):
    row = S.parse_schedules(spark.sql("SELECT 1 AS uid, CAST(NULL AS STRING) AS cron")).first()
    assert not row.valid and row.error == "no rule"


def matches(rule: dict, ts: datetime) -> bool:
    parts = {"minute": ts.minute, "hour": ts.hour, "day": ts.day, "month": ts.month,
             "weekday": ts.isoweekday(), "year": ts.year}
    return all(rule[k] is None or v in rule[k] for k, v in parts.items())


def test_match_golden_instants(spark):
    rule = "*/15 */6 3,15,31 3,8,10 1-5 *"
    yes = ["2015-08-03 06:45", "2015-10-15 06:30", "2015-03-31 18:30"]
    no = ["2015-03-20 12:00", "2015-04-15 18:30"]
    df = spark.createDataFrame([(t,) for t in yes + no], "t string").withColumn(
        "ts", F.col("t").cast("timestamp_ntz"))
    assert [r.t for r in df.filter(cron_match("ts", rule)).collect()] == yes
    zoned = df.withColumn("ts", F.col("t").cast("timestamp"))
    assert [r.t for r in zoned.filter(cron_match("ts", rule)).collect()] == yes


def test_year_range_reaches_the_scan(spark, tmp_path):
    spark.sql("SELECT timestamp_ntz'2015-06-07 17:45:10' AS ts UNION ALL SELECT timestamp_ntz'2017-06-07 17:45:10'"
              ).write.parquet(str(tmp_path / "e"))
    due = S.cron_filter(spark.read.parquet(str(tmp_path / "e")), "ts", "45 17 7 6 * 2015,2016")
    plan = due._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2015-01-01" in plan and "LessThan(ts,2017-01-01" in plan
    assert due.count() == 1


def brute_fires(rules: list[str], start: datetime, end: datetime) -> set[tuple[int, datetime]]:
    found, ts = set(), start.replace(second=0)
    if ts < start:
        ts += timedelta(minutes=1)
    read = {}
    for uid, rule in enumerate(rules):
        try:
            read[uid] = compile_rule(rule)
        except ValueError:
            pass
    while ts < end:
        found |= {(uid, ts) for uid, rule in read.items() if matches(rule, ts)}
        ts += timedelta(minutes=1)
    return found


@pytest.mark.parametrize("start, end", [
    (datetime(2024, 2, 27, 22, 17), datetime(2024, 3, 2, 3, 5)),
    (datetime(2031, 12, 31, 20, 0), datetime(2032, 1, 1, 2, 0)),  # beyond the last year a rule can name
    (datetime(2024, 1, 1, 0, 0, 30), datetime(2024, 1, 1, 0, 3)),
])
def test_fire_times_against_brute_force(spark, start, end):
    rng = random.Random(3)
    rules = GOOD + BAD + [random_rule(rng) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(rules)), "uid bigint, cron string")
    fires = [(r.timetable_uid, r.fire_ts) for r in S.fire_times(df, start, end).collect()]
    assert len(fires) == len(set(fires))
    assert set(fires) == brute_fires(rules, start, end)


def match_tables(spark, seed: int, hot_minute: bool):
    rng = random.Random(seed)
    base = datetime(2024, 2, 28)
    rules = ["* * * * * *", "*/5 * * * * *", "7 */3 * FEB,3 * *", "0 0 1 * * *"] * 3
    rules += GOOD + BAD + [random_rule(rng) for _ in range(30)]
    states = ["ACTIVE", "ACTIVE", "PAUSED", "CANCELLED"]
    tables = [(i, r, rng.choice(states)) for i, r in enumerate(rules)]
    times = [base + timedelta(seconds=rng.randint(0, 3 * 86400)) for _ in range(300)]
    if hot_minute:  # a third of all events in one minute
        times += [datetime(2024, 2, 29, 9, 15, rng.randint(0, 59)) for _ in range(150)]
    events = spark.createDataFrame(
        [(i, t) for i, t in enumerate(times)], "event_id bigint, ts timestamp_ntz")
    return tables, times, events, spark.createDataFrame(tables, "uid bigint, cron string, status string")


@pytest.mark.parametrize("seed, hot", [(1, False), (2, True)])
def test_matching_against_brute_force(spark, seed, hot):
    tables, times, events, timetables = match_tables(spark, seed, hot)
    want = set()
    for uid, rule, state in tables:
        try:
            read = compile_rule(rule)
        except ValueError:
            continue
        if state == "ACTIVE":
            want |= {(i, uid) for i, t in enumerate(times) if matches(read, t)}
    pairs = [(r.event_id, r.timetable_uid) for r in S.match_schedules(events, timetables).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    for row in S.match_summary(events, timetables).collect():
        mine = [times[i] for i, uid in want if uid == row.timetable_uid]
        assert row.matches == len(mine)
        assert (row.first_ts, row.last_ts) == ((min(mine), max(mine)) if mine else (None, None))
    by_rule = {(r.event_id, r.cron) for r in S.match_rules(events, S.active(timetables)).collect()}
    assert by_rule == {(i, tables[uid][1]) for i, uid in want}


def test_due_minutes_may_be_written_first(spark, tmp_path):
    _, _, events, timetables = match_tables(spark, 3, True)
    S.due_minutes(events, S.active(timetables)).write.parquet(str(tmp_path / "due"))
    due = spark.read.parquet(str(tmp_path / "due"))
    for match, tables in ((S.match_rules, S.active(timetables)), (S.match_schedules, timetables)):
        plain, written = match(events, tables), match(events, tables, due=due)
        assert sorted(map(tuple, written.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    plan = S.match_rules(events, timetables, due=due)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [minute" in plan and "hashpartitioning" not in plan  # events stay in place


def test_hot_rule_and_hot_minute_are_dealt_out(spark):
    base = datetime(2024, 2, 28)
    events = spark.createDataFrame(
        [(i, base + timedelta(minutes=(i * 7) % 4000)) for i in range(400)] + [(i, base) for i in range(400, 600)],
        "event_id bigint, ts timestamp_ntz")
    rules = ["* * * * * *", "*/2 * * * * *", "* */2 * * * *", "* * 29 * * *"]
    timetables = spark.createDataFrame(
        [(i, rules[0 if i % 2 else i // 2 % 4], "ACTIVE") for i in range(300)], "uid bigint, cron string, status string")
    pairs = S.match_schedules(events, timetables, most=300)
    made = sorted(r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect())
    assert len(made) == int(spark.conf.get("spark.sql.shuffle.partitions")) and made[-1] < 2 * made[len(made) // 2]
    whole = S.match_schedules(events, timetables)
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, whole.select(pairs.columns).collect()))


@pytest.mark.parametrize("most", [1, 4, 50, 10**9])
def test_tiles_hold_every_pair_once(spark, most):
    rng = random.Random(most)
    rows = [[(i, rng.choice([None, "a", "a", "a", "b", "c"])) for i in range(n)] for n in (60, 35)]
    rows[0] += rows[0][:5]
    left = spark.createDataFrame(rows[0], "l bigint, k string")
    right = spark.createDataFrame(rows[1], "r bigint, k string").withColumn("m", F.create_map(F.lit("x"), "r"))
    sizes = left.groupBy("k").agg(F.count("*").alias("lefts")).join(right.groupBy("k").agg(F.count("*").alias("rights")), "k")
    got = sorted((r.l, r.r, r.k) for r in tiled_join(left, right, "k", sizes, most).collect())
    assert got == sorted((a, b, k) for a, k in rows[0] for b, other in rows[1] if k is not None and k == other)


def test_matching_makes_no_nested_loop(spark):
    _, _, events, timetables = match_tables(spark, 1, False)
    for df in (S.match_schedules(events, timetables), S.match_summary(events, timetables)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_spawned_runs(spark):
    timetables = spark.createDataFrame(
        [(1, "nightly", "ACTIVE", "* * * * * *", 10), (2, "paused", "PAUSED", "* * * * * *", 10),
         (3, "orphan", "ACTIVE", "* * * * * *", 99)],
        "uid bigint, name string, status string, cron string, job_uid bigint")
    jobs = spark.sql("""SELECT 10L AS uid, 'template' AS name, 'FINISHED' AS status, 'com.test.Main' AS entrypoint,
        '/tmp/file.jar' AS jar, map('a', 'b') AS options, array('x') AS jobconf""")
    fires = spark.sql("""SELECT explode(array(1L, 2L, 3L)) AS timetable_uid, timestamp_ntz'2024-01-01 00:01:00'
        AS fire_ts""")
    runs, log = S.spawn_runs(fires, timetables, jobs)
    run = runs.collect()
    assert len(run) == 1
    ms = 1704067260000
    assert run[0].asDict() == {
        "timetable_uid": 1, "name": f"nightly-T-{ms}", "status": "READY", "createtime": ms, "submittime": ms,
        "starttime": None, "finishtime": None, "priority": ms, "sparkappid": None, "template_job_uid": 10,
        "entrypoint": "com.test.Main", "jar": "/tmp/file.jar", "options": {"a": "b"}, "jobconf": ["x"]}
    assert [tuple(r) for r in log.collect()] == [(1, f"nightly-T-{ms}", ms)]
    minute = datetime(2024, 1, 1, 0, 1)
    planned, planned_log = S.planned_runs(timetables, jobs, minute, minute + timedelta(minutes=1))
    assert planned.collect() == run and planned_log.collect() == log.collect()


def test_expanded_fires_are_not_broadcast(spark):
    timetables = spark.createDataFrame(
        [(1, "a", "ACTIVE", "* * * * * *", 10)], "uid bigint, name string, status string, cron string, job_uid bigint")
    jobs = spark.sql("SELECT 10L AS uid, 'M' AS entrypoint, '/a.jar' AS jar, map('a', 'b') AS options, array('x') AS jobconf")
    window = datetime(2024, 1, 1), datetime(2024, 2, 1)
    runs, _ = S.spawn_runs(S.fire_times(timetables, *window), timetables, jobs)
    planned, _ = S.planned_runs(timetables, jobs, *window)
    assert runs.count() == planned.count() == 31 * 1440
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [timetable_uid" in plan
    assert planned._jdf.queryExecution().executedPlan().toString().count("Join") == 1
