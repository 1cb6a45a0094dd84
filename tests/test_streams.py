"""Streams of several batches give what the batch operators give; sources and sinks."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.operators import history as H
from tickloom.operators import logs, records, schedules, status
from tickloom.sources import logs as log_files
from tickloom.sources import tables
from tickloom.streaming import ledger, streams


def land(df, folder, parts: int):
    """The rows as ``parts`` files that a stream reads one by one, in order of ``n``."""
    rows, first = df.agg(F.count("*"), F.min("n")).first()
    for i in range(parts):
        part = df.filter(F.floor((F.col("n") - first) * parts / rows) == i)
        part.coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, df, folder, parts=4):
    land(df, folder, parts)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


@pytest.fixture
def ticks(spark):
    start = datetime(2024, 1, 5, 8, 50)
    rows = [(n, start + timedelta(seconds=20 * n)) for n in range(120)]
    return spark.createDataFrame(rows, "n bigint, ts timestamp_ntz")


def test_cron_stream(spark, ticks, tmp_path):
    rule = "*/15 9 * * FRI *"
    due = schedules.cron_filter(stream(spark, ticks, tmp_path / "in"), "ts", rule)
    streams.append_rows(due, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.n for r in spark.read.schema(due.schema).parquet(str(tmp_path / "out")).collect()}
    assert got == {r.n for r in schedules.cron_filter(ticks, "ts", rule).collect()} and len(got) == 6


def test_due_runs_stream(spark, ticks, tmp_path):
    timetables = spark.createDataFrame(
        [(1, "all", "ACTIVE", "* * * * * *", 10), (2, "quarter", "ACTIVE", "*/15 * * * * *", 10),
         (3, "paused", "PAUSED", "* * * * * *", 10), (4, "bad", "ACTIVE", "x", 10)],
        "uid bigint, name string, status string, cron string, job_uid bigint")
    jobs = spark.sql("SELECT 10L AS uid, 'Main' AS entrypoint, '/a.jar' AS jar, map('a','b') AS options, array('x') AS jobconf")
    out = str(tmp_path / "out")
    query = streams.follow_due_runs(
        stream(spark, ticks, tmp_path / "in", 5), timetables, jobs, out, str(tmp_path / "cp"))
    query.awaitTermination()
    got = sorted((r.timetable_uid, r.createtime) for r in ledger.read(spark, f"{out}/runs").collect())
    fires = schedules.fire_times(schedules.active(timetables), datetime(2024, 1, 5, 8, 50), datetime(2024, 1, 5, 9, 30))
    want, _ = schedules.spawn_runs(fires, timetables, jobs)
    assert got == sorted((r.timetable_uid, r.createtime) for r in want.collect()) and len(got) == 40 + 2
    log = ledger.read(spark, f"{out}/log")
    assert sorted((r.timetable_uid, r.createtime) for r in log.collect()) == got
    assert len({r.batch for r in log.select("batch").distinct().collect()}) > 1


def test_ticks_out_of_order(spark, tmp_path):
    """Minutes that tick days late, or again in later batches, give the runs of A5 all the same."""
    start = datetime(2024, 1, 5, 8, 0)
    minutes = [start + timedelta(days=n * 7 % 4, minutes=n * 13 % 50) for n in range(60)]
    rows = [(n, m + timedelta(seconds=n % 60)) for n, m in enumerate([*minutes, *minutes[::-3]])]
    ticks = spark.createDataFrame(rows, "n bigint, ts timestamp_ntz")
    timetables = spark.createDataFrame([(1, "all", "ACTIVE", "* * * * * *", 10), (2, "some", "ACTIVE", "*/5 * * * * *", 10)],
                                       "uid bigint, name string, status string, cron string, job_uid bigint")
    jobs = spark.sql("SELECT 10L AS uid, 'Main' AS entrypoint, '/a.jar' AS jar, map('a','b') AS options, array('x') AS jobconf")
    out = str(tmp_path / "out")
    streams.follow_due_runs(stream(spark, ticks, tmp_path / "in", 6), timetables, jobs, out, str(tmp_path / "cp")).awaitTermination()
    got = sorted((r.timetable_uid, r.createtime) for r in ledger.read(spark, f"{out}/runs").collect())
    fires = schedules.fire_times(schedules.active(timetables), start, start + timedelta(days=5))
    fires = fires.join(ticks.select(schedules.to_minute(F.col("ts")).alias("fire_ts")).distinct(), "fire_ts")
    want, _ = schedules.spawn_runs(fires, timetables, jobs)
    assert got == sorted((r.timetable_uid, r.createtime) for r in want.collect()) and len(got) > len(set(minutes))
    assert len({r.batch for r in ledger.read(spark, f"{out}/runs").select("batch").distinct().collect()}) > 1
    assert stored(spark, tmp_path / "cp").count() == len(set(minutes))


def test_runs_of_the_minutes_of_rules(spark):
    """Minutes per rule give the runs that fires per timetable give, in tiles of any size."""
    timetables = spark.createDataFrame(
        [(uid, f"t{uid}", "PAUSED" if uid % 7 == 0 else "ACTIVE", "* * * * * *" if uid % 3 else "*/5 * * * * *", uid % 4) for uid in range(40)],
        "uid bigint, name string, status string, cron string, job_uid bigint")
    jobs = spark.sql("SELECT explode(array(0L, 1L, 2L)) AS uid, 'Main' AS entrypoint, '/a.jar' AS jar, map('a','b') AS options, array('x') AS jobconf")
    start, end = datetime(2024, 1, 5, 8, 0), datetime(2024, 1, 5, 8, 30)
    minutes = spark.createDataFrame([(start + timedelta(minutes=n),) for n in range(30)], "minute timestamp_ntz")
    due = schedules.rule_minutes(minutes, timetables).select("cron", "minute").persist()
    want, _ = schedules.planned_runs(timetables, jobs, start, end)
    for most in (8, 1 << 20):
        got = schedules.spawn_due(due, timetables, jobs, most)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 500


def test_paused_while_the_stream_runs(spark, ticks, tmp_path):
    jobs = spark.sql("SELECT 10L AS uid, 'Main' AS entrypoint, '/a.jar' AS jar, map('a','b') AS options, array('x') AS jobconf")
    reads = []

    def timetables():
        reads.append(None)
        state = "ACTIVE" if len(reads) <= 2 else "PAUSED"
        return spark.createDataFrame([(1, "all", state, "* * * * * *", 10)],
                                     "uid bigint, name string, status string, cron string, job_uid bigint")

    out = str(tmp_path / "out")
    streams.follow_due_runs(
        stream(spark, ticks, tmp_path / "in", 4), timetables, jobs, out, str(tmp_path / "cp")).awaitTermination()
    assert len(reads) == 4
    assert stored(spark, tmp_path / "cp").count() == 40
    assert ledger.read(spark, f"{out}/runs").count() == 20


def transitions(spark):
    actions = ["run", "finish", "close", "run", "bogus"]
    rows = [(n, f"k{n * 7 % 13}", n, n, actions[n * 3 % 5]) for n in range(300)]
    return spark.createDataFrame(rows, "n bigint, key string, ts bigint, seq bigint, action string")


def settled(df):
    return sorted(tuple(r) for r in df.collect())


def stored(spark, checkpoint):
    """The rows of a stream's state."""
    return spark.read.format("statestore").load(str(checkpoint))


def in_arrival(rows, machine, batches, start=None):
    """What each key has come to when its events are applied batch by batch, and how many came late."""
    found, last = {}, {}
    for part in batches:
        for key, ts, seq, action in sorted((r for r in part if r[3] is not None), key=lambda r: (r[1], r[2], r[3])):
            state = found.setdefault(key, [(start or {}).get(key, machine.initial), dict.fromkeys(machine.stamps.values()), 0, 0, 0])
            state[4] += key in last and last[key][0] is not part and (ts, seq) < last[key][1]
            target = machine.moves.get((state[0], action))
            state[2 if target else 3] += 1
            if target:
                state[0] = target
                if action in machine.stamps:
                    state[1][machine.stamps[action]] = ts
        for key, ts, seq, _ in part:
            last[key] = (part, max((ts, seq), last[key][1] if key in last else (ts, seq)))
    return sorted((k, s[0], *s[1].values(), *s[2:]) for k, s in found.items())


def test_status_stream(spark, tmp_path):
    events = transitions(spark)
    path, checkpoint = str(tmp_path / "states"), str(tmp_path / "cp")
    source = stream(spark, events, tmp_path / "in", 6)
    streams.follow_transitions(source, H.JOB_MACHINE, path, checkpoint).awaitTermination()
    want = settled(H.replay_transitions(events, H.JOB_MACHINE))
    assert settled(streams.states_now(spark, path).drop("late")) == want
    assert streams.states_now(spark, path).filter("late > 0").count() == 0
    assert stored(spark, checkpoint).count() == len(want) == 13
    # continued after a stop
    more = events.select((F.col("n") + 300).alias("n"), "key", (F.col("ts") + 1000).alias("ts"),
                         (F.col("seq") + 300).alias("seq"), "action")
    land(more, tmp_path / "in", 2)
    streams.follow_transitions(source, H.JOB_MACHINE, path, checkpoint).awaitTermination()
    want = settled(H.replay_transitions(events.unionByName(more), H.JOB_MACHINE))
    assert settled(streams.states_now(spark, path).drop("late")) == want
    assert stored(spark, checkpoint).count() == 13


@pytest.mark.parametrize("machine", [H.JOB_MACHINE, H.TIMETABLE_MACHINE], ids=["job", "timetable"])
def test_late_events_and_given_states(spark, tmp_path, machine):
    actions = [*machine.actions, "bogus", None]
    rows = [(n, f"k{n * 5 % 7 if n % 4 else 0}", n * 37 % 101, n % 3, actions[n * 13 % len(actions)]) for n in range(400)]
    events = spark.createDataFrame(rows, "n bigint, key string, ts bigint, seq bigint, action string")
    start = {"k1": sorted(machine.states)[0], "k2": "unheard of", "k0": sorted(machine.states)[-1]}
    initial = spark.createDataFrame(list(start.items()), "key string, status string")
    path = str(tmp_path / "states")
    streams.follow_transitions(stream(spark, events, tmp_path / "in", 5), machine, path, str(tmp_path / "cp"), initial=initial).awaitTermination()
    parts = [[r[1:] for r in rows[i * 80 : i * 80 + 80]] for i in range(5)]
    parts = [[r for r in part if r[3] is not None] for part in parts]
    want = in_arrival(rows, machine, parts, {k: v for k, v in start.items() if v in machine.states})
    assert settled(streams.states_now(spark, path)) == want
    assert sum(r[-1] for r in want) > 100


def test_hot_key_in_a_stream(spark, tmp_path):
    """Enough events of one key in a batch that they are folded as arrays."""
    actions = ["pause", "resume", "bogus", "resume", "pause"]
    rows = [(n, "hot" if n % 9 else f"k{n % 4}", n // 2, n, actions[n * 7 % 5] if n < 2900 else "cancel") for n in range(3000)]
    events = spark.createDataFrame(rows, "n bigint, key string, ts bigint, seq bigint, action string")
    path = str(tmp_path / "states")
    streams.follow_transitions(stream(spark, events, tmp_path / "in", 4), H.TIMETABLE_MACHINE, path, str(tmp_path / "cp")).awaitTermination()
    assert settled(streams.states_now(spark, path).drop("late")) == settled(H.replay_transitions(events, H.TIMETABLE_MACHINE))


def test_repeated_batch_counts_once(spark, tmp_path):
    events = transitions(spark)
    path = str(tmp_path / "states")
    source = stream(spark, events, tmp_path / "in", 1)
    for attempt in range(2):  # as if the first had been lost before its commit
        checkpoint = str(tmp_path / f"cp-{attempt}")
        streams.follow_transitions(source, H.JOB_MACHINE, path, checkpoint).awaitTermination()
    assert settled(streams.states_now(spark, path).drop("late")) == settled(
        H.replay_transitions(events, H.JOB_MACHINE))


def test_keys_share_rows_of_state(spark, tmp_path, monkeypatch):
    """Far fewer calls and rows of state than keys, and each key's own result."""
    monkeypatch.setattr(streams, "_GROUPS", 3)
    actions = ["run", "finish", "close", "bogus", None]
    rows = [(n, n * 37 % 211 if n % 3 else n % 19, 2**53 + n * 37 % 101, n % 7, actions[n * 13 % 5]) for n in range(1500)]
    events = spark.createDataFrame(rows, "n bigint, key bigint, ts bigint, seq bigint, action string")
    path = str(tmp_path / "states")
    streams.follow_transitions(stream(spark, events, tmp_path / "in", 3), H.JOB_MACHINE, path, str(tmp_path / "cp")).awaitTermination()
    parts = [[r[1:] for r in rows[i * 500 : i * 500 + 500] if r[4] is not None] for i in range(3)]
    assert settled(streams.states_now(spark, path)) == in_arrival(rows, H.JOB_MACHINE, parts)
    assert stored(spark, tmp_path / "cp").count() == 3


def test_run_totals_stream(spark, tmp_path):
    stats = spark.range(500).selectExpr(
        "id AS n", "id % 7 AS timetable_uid", "id AS job_uid", "id div 3 AS createtime")
    path = str(tmp_path / "totals")
    streams.follow_run_totals(stream(spark, stats, tmp_path / "in"), path, str(tmp_path / "cp")).awaitTermination()
    got = ledger.read_latest(spark, path, "timetable_uid").select("timetable_uid", "jobs", "last_time", "last_job_uid")
    assert settled(got) == settled(records.run_totals(stats))


def test_cluster_status_stream(spark, tmp_path):
    bodies = spark.range(40).selectExpr(
        "id AS n", """CASE id % 3 WHEN 0 THEN '[]'
        WHEN 1 THEN '[{"id":"a","name":"b","attempts":[{"completed":false}]}]' END AS body""")
    rows = status.cluster_status(stream(spark, bodies, tmp_path / "in")).drop("body")
    streams.append_rows(rows, str(tmp_path / "out"), str(tmp_path / "cp"),
                        {"availableNow": True}).awaitTermination()
    got = {r.n: r.cluster_status for r in spark.read.schema(rows.schema).parquet(str(tmp_path / "out")).collect()}
    assert got == {n: {0: 0, 1: -1, 2: -2}[n % 3] for n in range(40)}


# -- sources and sinks ---------------------------------------------------------


def test_log_files(spark, tmp_path):
    text = "".join(f"row {i} é\n" for i in range(900)).encode()
    files = {(1, "stdout"): text, (1, "stderr"): b"", (22, "stdout"): text[:77], (3, "stderr"): b"\n" * 5}
    for (uid, kind), data in files.items():
        folder = tmp_path / "work" / f"job-{uid}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / kind).write_bytes(data)
        (folder / "_metadata").write_text("{}")
    (tmp_path / "work" / "other").mkdir()
    (tmp_path / "work" / "other" / "stdout").write_text("not a job")
    root = str(tmp_path / "work")
    read = log_files.read_logs(spark, root)
    assert {(r.uid, r.type): bytes(r.content) for r in read.collect()} == files
    want = logs.paginate(read.drop("length"), "content", 100, 30)
    got = log_files.read_log_pages(spark, root, 100, 30)
    as_rows = lambda df: sorted((r.uid, r.type, r.page, r.page_count, bytes(r.block)) for r in df.collect())
    assert as_rows(got) == as_rows(want) and got.count() > 90
    assert log_files.read_log_pages(spark, root).count() == 4  # one page of 64 KiB each
    jobs = spark.sql("SELECT explode(array(1L, 22L, 3L, 404L)) AS uid")
    named = as_rows(log_files.read_log_pages(spark, root, 100, 30, jobs))
    assert named == as_rows(want) and (1, "stderr", 1, 1, b"") in named


def test_metadata_round_trip(spark, tmp_path):
    schema = tables.SCHEMAS["job"]
    rows = [(1, "a\"b", "READY", 1, 1, None, None, 1, None, "Main", "/a.jar", {"x": "y\n"}, ["--a", ""]),
            (2, "c", "CLOSED", 1, 1, 2, 3, 1, "app", "Main", "/a.jar", {}, [])]
    jobs = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "meta")
    tables.write_metadata(jobs, path)
    assert {p.name for p in (tmp_path / "meta").iterdir() if p.is_dir()} == {"status=READY", "status=CLOSED"}
    assert sorted(tables.read_metadata(spark, path).collect()) == sorted(jobs.collect())


def test_stored_tables(spark, tmp_path):
    jobs = spark.createDataFrame(
        [(1, "a", "READY", 1, 1, None, None, 1, None, "Main", "/a.jar", {"x": "y"}, ["z"])], tables.SCHEMAS["job"])
    for name, schema in tables.SCHEMAS.items():
        df = jobs if name == "job" else spark.createDataFrame([], schema)
        df.write.parquet(str(tmp_path / name))
    read = tables.read_tables(spark, str(tmp_path))
    assert set(read) == set(tables.SCHEMAS) and read["job"].collect() == jobs.collect()
    text = jobs.withColumn("options", F.to_json("options")).withColumn("jobconf", F.to_json("jobconf"))
    assert tables.decode_jobs(text).collect() == jobs.collect()


def test_database_reads_are_split():
    options = tables.jdbc_options("jdbc:mysql://h:1/d", "timetable_stats", 8, (1, 100), user="u")
    assert options["partitionColumn"] == "timetable_uid" and options["numPartitions"] == "8"
    assert options["dbtable"] == "timetable_stats" and options["user"] == "u"
    assert (options["lowerBound"], options["upperBound"]) == ("1", "101")
    assert tables.bounds_query("timetable_stats") == "SELECT MIN(timetable_uid) AS low, MAX(timetable_uid) AS high FROM timetable_stats"
    assert tables.jdbc_options("jdbc:mysql://h:1/d", "job", 8, (5, 7))["numPartitions"] == "3"
    assert tables.jdbc_options("jdbc:mysql://h:1/d", "job", 8, (5, 5))["numPartitions"] == "1"
    empty = tables.jdbc_options("jdbc:mysql://h:1/d", "job", 8, (None, None), user="u")
    assert empty == {"url": "jdbc:mysql://h:1/d", "dbtable": "job", "user": "u"}


def test_scratch_needs_a_shared_folder(spark):
    from tickloom.session import scratch_dir
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    first, second = scratch_dir(spark), scratch_dir(spark)
    assert first.startswith(root) and first != second


def test_short_logs_share_a_batch(tmp_path, monkeypatch):
    monkeypatch.setattr(log_files, "_HELD", 100)
    sizes = [10, 0, 30, 250, 5, 60, 60]
    rows = []
    for uid, size in enumerate(sizes):
        (tmp_path / str(uid)).write_bytes(b"x" * size)
        rows.append({"path": str(tmp_path / str(uid)), "uid": uid, "type": "stdout", "length": size})
    batches = [b.to_pylist() for b in log_files._contents([log_files.pa.RecordBatch.from_pylist(rows)])]
    assert [[r["uid"] for r in b] for b in batches] == [[0, 1, 2], [3], [4, 5], [6]]
    assert [r["length"] for b in batches for r in b] == [len(r["content"]) for b in batches for r in b] == sizes


def test_requested_logs_are_looked_up_once(spark, tmp_path):
    for uid, text in ((1, "a" * 25), (2, "")):
        (tmp_path / f"job-{uid}").mkdir()
        (tmp_path / f"job-{uid}" / "stdout").write_text(text)
    (tmp_path / "job-1" / "other").write_text("no log")
    asked = [(1, "stdout", 3), (1, "stdout", 1), (1, "stdout", 1), (1, "stdout", 4), (1, "stdout", 0), (1, "stdout", None), (1, "stderr", 1),
             (1, "other", 1), (2, "stdout", 1), (3, "stdout", 1), (None, "stdout", 1), (1, None, 1)]
    requests = spark.createDataFrame(asked, "uid long, type string, page long")
    read = log_files.read_log_pages(spark, str(tmp_path), 10, 0, requests=requests)
    assert read._jdf.queryExecution().executedPlan().toString().count("MapInArrow _stat") == 1
    there = {(1, "stdout", 3): b"aaaaa", (1, "stdout", 1): b"a" * 10, (2, "stdout", 1): b""}
    count = lambda uid, kind: {(1, "stdout"): 3, (2, "stdout"): 1}.get((uid, kind))
    want = {(*k, count(*k[:2]), there.get(k)) for k in asked}
    got = [(r.uid, r.type, r.page, r.page_count, r.block if r.block is None else bytes(r.block)) for r in read.collect()]
    assert set(got) == want and len(got) == len(want)
