"""Run statistics, enrichment, templates, documents, status snapshots, inventories."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tickloom.functions.paths import extension, within
from tickloom.operators import inventory as I
from tickloom.operators import records as R
from tickloom.operators import status as A


def test_run_stats(spark):
    timetables = spark.createDataFrame([(1, "a"), (2, "b")], "uid bigint, name string")
    stats = spark.createDataFrame([(1, i, i) for i in range(10)] + [(1, 3, 9)],
                                  "timetable_uid bigint, job_uid bigint, createtime bigint")
    rows = {r.uid: (r.jobs, r.last_time, r.last_job_uid) for r in R.run_stats(timetables, stats).collect()}
    assert rows == {1: (11, 9, 9), 2: (0, None, None)}
    big = spark.createDataFrame([(1, 2**63 - 1, 1), (1, 5, 0)], stats.schema)
    assert R.run_totals(big).first().last_job_uid == 2**63 - 1


def test_run_totals_of_odd_uids(spark):
    rows = [(1, -5, 3), (1, -9, 3), (2, 7, 1), (2, None, 2), (3, None, 4), (3, -1, 4), (4, 2**63 - 1, -8), (4, -(2**63), -9), (5, 1, None)]
    stats = spark.createDataFrame(rows, "timetable_uid bigint, job_uid bigint, createtime bigint")
    got = {r.timetable_uid: (r.jobs, r.last_time, r.last_job_uid) for r in R.run_totals(stats).collect()}
    assert got == {1: (2, 3, -5), 2: (2, 2, None), 3: (2, 4, -1), 4: (2, -8, 2**63 - 1), 5: (1, None, 1)}


def test_enrichment_and_elapsed(spark):
    timetables = spark.createDataFrame([(1, 10), (2, 99)], "uid bigint, job_uid bigint")
    jobs = spark.createDataFrame([(10, "j", 100, 5100), (11, "k", None, 7)],
                                 "uid bigint, name string, starttime bigint, finishtime bigint")
    rows = {r.uid: r.job for r in R.enrich_timetables(timetables, jobs).collect()}
    assert rows[1].name == "j" and rows[2] is None
    times = {r.uid: (r.elapsed_ms, r.elapsed_label) for r in R.elapsed(jobs).collect()}
    assert times == {10: (5000, "5sec (5000)"), 11: (None, None)}


def test_templates(spark):
    content = json.dumps({"name": "n", "entrypoint": "Main", "delay": "5", "other": 1})
    df = spark.createDataFrame([(1, content), (2, "{"), (3, None)], "uid bigint, content string")
    rows = {r.uid: r for r in R.expand_templates(df).collect()}
    assert (rows[1].job_name, rows[1].job_entrypoint, rows[1].job_delay, rows[1].job_jar) == ("n", "Main", "5", None)
    assert rows[2].job_name is None and rows[3].job_name is None
    assert rows[1].fields == {"name": "n", "entrypoint": "Main", "delay": "5", "other": "1"} and rows[2].fields is None


def test_template_keeps_its_keys(spark):
    df = spark.createDataFrame([(1, "t", ' {"key": "value", "z": {"a": [1, null]}} '), (2, "t", "{"), (3, "t", None)],
                               "uid bigint, name string, content string")
    got = {r.uid: json.loads(r.document)["content"] for r in R.to_documents(df, "template").collect()}
    assert got == {1: {"key": "value", "z": {"a": [1, None]}}, 2: None, 3: None}


def test_content_with_a_tail_is_no_document(spark):
    texts = ['{"a":1} tail', '{"a":1}}', '{"a":1},{"b":2}', '{"a":NaN}', "{'a':1}", '{"a":1,"a":2}', ' {"a":"8077001254390267311"}\n', '{"n":1e5}']
    df = spark.createDataFrame(list(enumerate(texts)), "uid bigint, content string").selectExpr("uid", "'t' AS name", "content", "uid * 2 AS later")
    found = {i: d for i, d in documents(df, "template").items()}
    assert [found[i]["content"] for i in range(8)] == [None] * 5 + [{"a": 2}, {"a": "8077001254390267311"}, {"n": 1e5}]
    assert [found[i]["later"] for i in range(8)] == list(range(0, 16, 2)) and list(found[0]) == ["uid", "name", "content", "later"]
    only = documents(df.select("uid", "content"), "template")
    assert list(only[6]) == ["uid", "content"]


def documents(df, kind):
    return {r.uid: json.loads(r.document) for r in R.to_documents(df, kind).collect()}


def test_documents(spark):
    states = ["READY", "DELAYED", "RUNNING", "FINISHED", "CLOSED"]
    jobs = spark.createDataFrame([(i, s, None) for i, s in enumerate(states)], "uid bigint, status string, starttime bigint")
    docs = documents(jobs, "job")
    assert docs[2] == {"uid": 2, "status": "RUNNING", "starttime": None, "can_close": False}
    assert [docs[i]["can_close"] for i in range(5)] == [True, True, False, False, False]
    tables = spark.createDataFrame([(1, "ACTIVE", 3), (2, "PAUSED", 0), (3, "CANCELLED", 0)],
                                   "uid bigint, status string, jobs bigint")
    docs = documents(tables, "timetable")
    flags = ("can_pause", "can_resume", "can_cancel")
    assert [tuple(docs[i][f] for f in flags) for i in (1, 2, 3)] == [
        (True, False, True), (False, True, True), (False, False, False)]
    assert docs[1]["stats"] == {"jobs": 3}
    rule = documents(spark.sql("SELECT 1L AS uid, 'ACTIVE' AS status, '5 * * JAN,2 * *' AS cron"), "timetable")[1]["cron"]
    assert rule == {"pattern": "5 * * JAN,2 * *", "minute": 5, "hour": None, "day": None, "month": [1, 2],
                    "weekday": None, "year": None}
    lone = spark.sql("SELECT 1L AS uid, 'ACTIVE' AS status, '*/60 5-5 7 dec Fri 2015,2015' AS cron, named_struct('uid', 4L, 'status', 'READY') AS job")
    found = documents(lone, "timetable")[1]
    assert {f: found["cron"][f] for f in ("minute", "hour", "day", "month", "weekday", "year")} == {
        "minute": [0], "hour": [5], "day": 7, "month": 12, "weekday": 5, "year": [2015]}
    assert found["job"] == {"uid": 4, "status": "READY", "can_close": True}
    assert documents(lone.withColumn("job", F.expr("if(uid = 0, job, null)")), "timetable")[1]["job"] is None
    bad = spark.createDataFrame([(1, "x y")], "uid bigint, cron string").withColumn("status", F.lit("ACTIVE"))
    assert not any(v for k, v in documents(bad, "timetable")[1]["cron"].items() if k != "pattern")
    templates = spark.createDataFrame([(1, '{"name": "x"}')], "uid bigint, content string")
    assert documents(templates, "template")[1]["content"]["name"] == "x"
    with pytest.raises(ValueError):
        R.to_documents(jobs, "other")


def test_snapshots(spark):
    bodies = [
        None, "[]", '{"key":}', "",
        '[{"id":"a","name":"x","attempts":[{"completed":false},{"completed":true}]}]',
        '[{"id":"a","name":"x","attempts":[{"completed":true}]},{"id":"b","name":"y"},{"id":"c","name":"z","attempts":[]}]',
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "n bigint, body string")
    status = {r.n: r.cluster_status for r in A.cluster_status(df).collect()}
    assert status == {0: A.DOWN, 1: A.FREE, 2: A.DOWN, 3: A.DOWN, 4: A.BUSY, 5: A.FREE}
    apps = A.parse_apps(df)
    rows = sorted((r.n, r.app_id, r.completed, r._corrupt) for r in apps.collect() if r.app_id or r._corrupt)
    assert [r for r in rows if r[1]] == [(4, "a", False, None), (5, "a", True, None), (5, "c", True, None)]
    assert (2, None, None, '{"key":}') in [tuple(r) for r in rows]
    assert [r.app_id for r in A.running_apps(apps).collect()] == ["a"]
    lists = {r.n: r.l for r in df.select("n", A.running_column(F.col("body")).alias("l")).collect()}
    assert lists[0] is None and lists[1] == [] and len(lists[4]) == 1
    assert "Exchange" not in A.cluster_status(df)._jdf.queryExecution().executedPlan().toString()


def test_bodies_are_not_copied_per_app(spark):
    df = spark.createDataFrame([(1, "[]")], "n bigint, body string")
    plan = A.parse_apps(df)._jdf.queryExecution().executedPlan().toString()
    generate = next(line for line in plan.splitlines() if "Generate" in line)
    assert "body" not in generate and "_corrupt" in generate


PATHS = ["/prod/start.jar", "/prod/a.txt", "/prod/sub/deep/x.JAR", "/b.jar", "/prod", "/z/.hidden", "/prod/start.jar",
         "relative/x.jar", "/bad//x.jar"]


def listing(df):
    return [(r.parent, r.name, r.isdir, r.type, r.path) for r in df.collect()]


def test_children(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    rows = listing(I.list_children(df))
    assert rows == [
        ("/", "prod", True, "dir", "/prod"), ("/", "z", True, "dir", "/z"), ("/", "b.jar", False, ".jar", "/b.jar"),
        ("/prod", "sub", True, "dir", "/prod/sub"), ("/prod", "a.txt", False, ".txt", "/prod/a.txt"),
        ("/prod", "start.jar", False, ".jar", "/prod/start.jar"),
        ("/prod/sub", "deep", True, "dir", "/prod/sub/deep"),
        ("/prod/sub/deep", "x.JAR", False, ".JAR", "/prod/sub/deep/x.JAR"),
        ("/z", ".hidden", False, "", "/z/.hidden"),
    ]
    assert [r for r in rows if r[0] == "/prod"] == listing(I.list_children(df, "/prod"))
    assert [r for r in rows if r[0] == "/"] == listing(I.list_children(df, "/"))
    jars = listing(I.list_children(df, "/prod/", (".jar",)))
    assert [r[1] for r in jars] == ["sub", "start.jar"]


def test_crumbs(spark):
    df = spark.createDataFrame([("/home/a/b",), ("/home",), ("/home2/a",), ("/home/a//b",)], "path string")
    rows = {r.path: r.crumbs for r in I.breadcrumbs(df, "/home").collect()}
    assert [tuple(c) for c in rows["/home/a/b"]] == [("home", "/home"), ("a", "/home/a"), ("b", "/home/a/b")]
    assert [tuple(c) for c in rows["/home"]] == [("home", "/home")]
    assert rows["/home2/a"] is None and rows["/home/a//b"] is None
    root = I.breadcrumbs(df).collect()[0].crumbs
    assert [tuple(c) for c in root] == [("home", "/"), ("home", "/home"), ("a", "/home/a"), ("b", "/home/a/b")]


def test_path_functions(spark):
    names = ["a.jar", "a.b.c", ".bashrc", ".a.b", "x", "a.", "...", "..a.b"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    import os.path
    assert [r[0] for r in df.select(extension("n")).collect()] == [os.path.splitext(n)[1] for n in names]
    paths = spark.createDataFrame([("/home",), ("/home/x",), ("/home2",), ("/",)], "p string")
    assert [r[0] for r in paths.select(within("p", "/home")).collect()] == [True, True, False, False]
    assert [r[0] for r in paths.select(within("p", "/")).collect()] == [True, True, True, True]


def test_check_sum_beyond_a_bigint(spark):
    """Times of millions of rows add up to more than a bigint holds."""
    from tickloom.plans.queries import check_sum

    def of(*values):
        rows = spark.createDataFrame([(v,) for v in values], "n bigint")
        return rows.agg(check_sum("n").alias("n"), F.typeof(check_sum("n")).alias("kind")).first()

    assert tuple(of(1_704_067_200_000, -5, None)) == (1_704_067_199_995, "bigint")
    assert of(2**63 - 1, 2**63 - 1, 7).n == 5 and of(-(2**63), -1).n == 2**63 - 1 and of().n is None
