"""Submission, listings and admission."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions.clean import TIMETABLE_STATUSES
from tickloom.operators import queue as Q
from tickloom.plans import flows


def submitted(spark, delays):
    rows = spark.createDataFrame(list(enumerate(delays)), "uid bigint, delay string")
    return {r.delay: r for r in Q.derive_submission(rows, 1_000_000).collect()}


def test_delay_decides_status_and_priority(spark):
    rows = submitted(spark, ["0", "1", "2", "2000", "-2000", "abc", None, " 5 "])
    assert (rows["0"].status, rows["0"].submittime, rows["0"].priority) == ("READY", 1_000_000, 1_000_000)
    assert (rows["1"].status, rows["1"].submittime, rows["1"].priority) == ("READY", 1_001_000, 1_001_000)
    assert (rows["2"].status, rows["2"].submittime, rows["2"].priority) == ("DELAYED", 1_002_000, 1_002)
    assert rows["2000"].submittime - rows["2000"].createtime == 2_000_000
    for text in ("-2000", "abc", None):
        assert (rows[text].status, rows[text].submittime) == ("READY", 1_000_000)
    assert rows[" 5 "].submittime == 1_005_000


@pytest.fixture(scope="module")
def jobs(spark):
    rows = [(1, "READY", 10, 10, 10), (2, "READY", 30, 30, 30), (3, "DELAYED", 20, 5000, 5),
            (4, "DELAYED", 40, 90000, 90), (5, "RUNNING", 50, 50, 50), (6, "READY", 30, 30, 30)]
    return spark.createDataFrame(
        rows, "uid bigint, status string, createtime bigint, submittime bigint, priority bigint")


def uids(df):
    return [r.uid for r in df.collect()]


def test_listing(jobs):
    assert uids(Q.list_by_status(jobs, "READY")) == [2, 6, 1]
    assert uids(Q.list_by_status(jobs, "ready", 1)) == [2]
    assert uids(Q.list_by_status(jobs, None, 0)) == [5, 4, 2, 6, 3, 1]
    assert uids(Q.list_by_status(jobs, "WRONG", -1)) == [5, 4, 2, 6, 3, 1]
    assert uids(Q.list_by_status(jobs, None, 2)) == [5, 4]
    assert len(uids(Q.list_by_status(jobs, "ACTIVE"))) == 6  # no status of jobs


def test_listing_timetables(spark):
    rows = [(1, "ACTIVE", 1), (2, "PAUSED", 2), (3, "CANCELLED", 3)]
    timetables = spark.createDataFrame(rows, "uid bigint, status string, createtime bigint")
    assert uids(Q.list_by_status(timetables, "paused", statuses=TIMETABLE_STATUSES)) == [2]
    assert uids(Q.list_by_status(timetables, "READY", 0, TIMETABLE_STATUSES)) == [3, 2, 1]
    assert sorted(uids(Q.list_enabled(timetables))) == [1, 2]


def test_queue_puts_delayed_first(jobs):
    assert uids(Q.runnable(jobs, 6000)) == [3, 1, 2, 6]
    assert uids(Q.runnable(jobs, 4999)) == [1, 2, 6]
    assert uids(Q.runnable(jobs, 6000, 2)) == [3, 1]
    assert uids(Q.runnable(jobs, 6000, 0)) == []
    assert uids(Q.running(jobs)) == [5]


def test_top_k_needs_no_full_sort(jobs):
    for df in (Q.runnable(jobs, 6000, 2), Q.list_by_status(jobs, "READY", 2)):
        assert "TakeOrderedAndProject" in df._jdf.queryExecution().executedPlan().toString()


def test_lookup_delete_close(spark, jobs):
    keys = spark.sql("SELECT explode(array(1L, 5L, 77L, 1L)) AS uid")
    assert sorted(uids(Q.lookup(jobs, keys))) == [1, 5]
    assert uids(Q.lookup(jobs, 3)) == [3] and uids(Q.lookup(jobs, 99)) == []
    assert sorted(uids(Q.delete_by_key(jobs, keys))) == [2, 3, 4, 6]
    assert sorted(uids(Q.delete_by_key(jobs, 4))) == [1, 2, 3, 5, 6]
    closed = Q.close_stale(jobs)
    assert {r.uid: r.status for r in closed.collect()}[5] == "CLOSED"
    assert Q.running(closed).count() == 0


def crowd(spark, seed: int):
    """A queue with a third of its rows in pool 0, many of equal priority."""
    rng = random.Random(seed)
    rows = [(i, 0 if rng.random() < 0.35 else rng.randint(0, 6), rng.randint(0, 40)) for i in range(4000)]
    busy = [(rng.randint(0, 6),) for _ in range(300)]
    queue = spark.createDataFrame(rows, "uid bigint, pool bigint, priority bigint")
    return rows, busy, queue, spark.createDataFrame(busy, "pool bigint")


def expected(rows, busy, slots, blocked=()):
    found = set()
    for pool in {r[1] for r in rows} - set(blocked):
        free = slots(pool) - sum(b[0] == pool for b in busy)
        ranked = sorted((p, u) for u, q, p in rows if q == pool)
        found |= {u for _, u in ranked[: max(free, 0)]}
    return found


@pytest.mark.parametrize("capacity", [0, 30, 60, 200, 1500, 5000])
def test_admission_against_brute_force(spark, capacity):
    rows, busy, queue, running = crowd(spark, capacity)
    got = uids(Q.admit(queue, running, capacity))
    assert len(got) == len(set(got)) and set(got) == expected(rows, busy, lambda _: capacity)


def test_admission_by_pool(spark):
    rows, busy, queue, running = crowd(spark, 5)
    slots = {0: 900, 1: 10_000, 2: 0, 3: 60, 4: 500}  # the others have none
    down = spark.sql("SELECT 4L AS pool")
    got = uids(Q.admit(queue, running, slots, down=down))
    table = spark.createDataFrame(list(slots.items()), "pool bigint, slots bigint")
    assert len(got) == len(set(got)) and set(got) == set(uids(Q.admit(queue, running, table, down=down)))
    assert set(got) == expected(rows, busy, lambda p: slots.get(p, 0), blocked=[4])


def test_full_tracked_pool_takes_nothing(spark):
    queue = spark.createDataFrame([(1, 0, 1), (2, 1, 1)], "uid bigint, pool bigint, priority bigint")
    none = spark.createDataFrame([], "pool bigint")
    tracked = spark.createDataFrame([(0,), (0,), (1,)], "pool bigint")
    assert uids(Q.admit(queue, none, 2, tracked=tracked)) == [2]


@pytest.mark.parametrize("capacity", [50, 10**6])
def test_no_window_over_a_pool(spark, capacity):
    _, _, queue, running = crowd(spark, 1)
    plan = Q.admit(queue, running, capacity)._jdf.queryExecution().executedPlan().toString()
    ranked = [line for line in plan.split("\n") if "row_number" in line and "Window [" in line]
    # the window's keys are the pool and the part or salt within it, its rows parts of a pool
    assert ranked and all(len(line[line.rindex(", [", 0, line.rindex(", [")) + 3 :].split("]")[0].split(",")) == 2 for line in ranked)


@pytest.mark.parametrize("capacity", [0, 1, 40, 700, 10**6])
def test_one_pool_of_equal_priorities(spark, capacity):
    """Ranked by uid alone, where a priority is shared by all or by most."""
    rows = [(n * 7919 % 3001, 5 if n % 10 else n) for n in range(3000)]
    queue = spark.createDataFrame(rows, "uid bigint, priority bigint")
    none = spark.createDataFrame([], "uid bigint")
    want = {u for _, u in sorted((p, u) for u, p in rows)[:capacity]}
    got = uids(Q.admit(queue, none, capacity, pool_col=None))
    assert len(got) == len(want) and set(got) == want


def test_admission_round_drops_bad_rows(spark):
    rows = [(1, 0, "4g", "com.test.Main", "/a.jar", "0"), (2, 0, "4x", "com.test.Main", "/a.jar", "0"),
            (3, 0, "4g", "com.test.Main", "/a.jar", "60"), (4, 0, "4g", "com.test.Main", "/a.jar", None)]
    subs = spark.createDataFrame(
        rows, "uid bigint, pool bigint, dmemory string, entrypoint string, jar string, delay string"
    ).withColumns({"ememory": F.col("dmemory"), "options": F.lit("")})
    none = spark.createDataFrame([], "pool bigint")
    assert sorted(uids(flows.admission_round(subs, none, 5, 1000))) == [1, 4]
    assert uids(flows.admission_round(subs, none, 1, 1000)) == [1]


def ranked(rows, free):
    """uids of the first ``free`` rows (uid, priority) by priority, then uid, nulls first."""
    first = lambda v: (v is not None, v if v is not None else 0)
    key = lambda r: (first(r[1]), (r[0] is not None, r[0] if r[0] is not None else ""))
    return [r[0] for r in sorted(rows, key=key)[:free]]


def test_missing_priorities_are_admitted_first(spark):
    for rows, slots in (([(1, None), (2, 1), (3, 2)], 5), ([(1, 3), (2, None)], 1), ([(1, None), (2, None), (3, None)], 2), ([(5, 2), (4, 2)], 1)):
        queue = spark.createDataFrame([(u, 0, p) for u, p in rows], "uid bigint, pool bigint, priority bigint")
        got = uids(Q.admit(queue, queue.filter("false"), slots))
        assert sorted(got) == sorted(ranked(rows, slots))


@pytest.mark.parametrize("slots", [1, 77, 400, 1100, 2500, 9000])
def test_names_as_uids_and_nulls(spark, slots):
    rng = random.Random(slots)
    rows = [(f"job-{rng.randint(0, 10**9):010d}" if i else None, rng.choice([None, 1, 2, 2, 2, 2, rng.randint(3, 99)])) for i in range(3000)]
    queue = spark.createDataFrame([(u, None if i % 500 == 499 else "p", p) for i, (u, p) in enumerate(rows)], "uid string, pool string, priority int")
    got = uids(Q.admit(queue, queue.filter("false"), slots))
    pooled = [r for i, r in enumerate(rows) if i % 500 != 499]
    assert sorted(got, key=str) == sorted(ranked(pooled, slots), key=str)


def test_one_priority_for_all(spark):
    queue = spark.range(20_000).selectExpr("id AS uid", "0 AS pool", "7 AS priority").repartition(5)
    assert sorted(uids(Q.admit(queue, queue.filter("false"), 1234))) == list(range(1234))


def test_columns_keep_their_names(spark):
    names = "rank part at end row salt free n cuts coarse left _pool _free _step".split()
    queue = spark.range(600).selectExpr("id AS uid", "id % 3 AS pool", "id % 11 AS priority", *[f"concat('{c}', id) AS {c}" for c in names])
    got = Q.admit(queue, queue.filter("uid < 0"), 50)
    assert got.columns == queue.columns and got.count() == 150
    assert {tuple(r) for r in got.collect()} <= {tuple(r) for r in queue.collect()}


def test_admission_of_an_empty_queue(spark, jobs):
    queue = jobs.withColumn("pool", F.lit(1)).filter("false")
    assert uids(Q.admit(queue, queue, 5)) == [] and uids(Q.admit(queue, queue, {1: 3}, pool_col=None)) == []


def test_admission_reads_the_queue_few_times(spark, tmp_path):
    spark.range(5000).selectExpr("id AS uid", "id % 3 AS pool", "id % 97 AS priority").write.parquet(str(tmp_path / "q"))
    queue = spark.read.parquet(str(tmp_path / "q"))
    plan = Q.admit(queue, queue.filter("uid < 9"), 700)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 8
