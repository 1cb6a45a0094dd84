"""Every operator over the whole of the given tables, by name."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import clean, paths
from tickloom.functions.cron import FIELDS
from tickloom.operators import history, html, inventory, logs, quality, queue, records, schedules, status
from tickloom.operators.spread import packed_join, spread
from tickloom.plans import fixtures as fx
from tickloom.plans import flows
from tickloom.session import scratch_dir
from tickloom.sources import logs as log_files
from tickloom.sources import tables as stored
from tickloom.streaming import ledger, streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

OFFICE_HOURS = "*/15 8-17 * * MON-FRI *"
# A moment with some delayed jobs due and some not.
NOW_MS = 909_100_800_000  # 1998-10-23
MONTH = (datetime(2024, 1, 1), datetime(2024, 2, 1))
DAY = (datetime(2024, 1, 5, 6, 30), datetime(2024, 1, 6, 6, 30))
GLOBAL_SLOTS = 3000
POOL_SLOTS = {0: 200_000, 1: 0, 2: 650, 3: 700, 4: 5000, 5: 700, 7: 1000}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "events")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = events(spark, sf_dir).schema
    # as a pattern the path may be one file as well as a folder of files
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def event_batches(spark: SparkSession, sf_dir: str, batches: int = 4, files: int = 4) -> DataFrame:
    """The events as a stream of several micro-batches, in order of time; the events of one time stay together."""
    rows, folder = events(spark, sf_dir), scratch_dir(spark)
    second = F.unix_timestamp(F.col("ts").cast("timestamp"))
    ends = rows.select(second.alias("second")).approxQuantile("second", [k / batches for k in range(1, batches)], 0.001)
    for low, high in zip([None, *ends], [*ends, None]):
        part = rows if low is None else rows.filter((second > low) | second.isNull())
        part = part if high is None else part.filter(second <= high)
        part.repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select("doc_id", "text")


def map_text(pairs: Column) -> Column:
    """Map entries as sorted text, which any engine can compare."""
    return F.array_join(
        F.array_sort(F.transform(F.map_entries(pairs), lambda e: F.concat(e["key"], F.lit("="), e["value"]))),
        ";",
    )


# -- A: calendar schedules -----------------------------------------------------


@query
def a1_parse_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = schedules.parse_schedules(fx.parser_rules(spark, sf_dir))
    values = [F.array_join(f"{f.name}_values", ",").alias(f"{f.name}_values") for f in FIELDS]
    return parsed.select("uid", "valid", "error", *values, "hour_mask", "year_mask")


@query
def a2_cron_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedules.cron_filter(events(spark, sf_dir), "ts", OFFICE_HOURS).select("event_id", "ts")


@query
def a2_cron_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = schedules.cron_filter(events(spark, sf_dir), "ts", OFFICE_HOURS)
    return due.groupBy("event_type").agg(F.count("*").alias("events"))


@query
def a2_cron_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule with years and names, whose range reaches the file scan."""
    due = schedules.cron_filter(events(spark, sf_dir), "ts", "* 0,12 */5 jan,MAR SAT,sun 2024")
    return due.groupBy("event_type").agg(F.count("*").alias("events"))


@query
def a3_match_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, folder = schedules.active(fx.timetables(spark, sf_dir)), scratch_dir(spark)
    schedules.due_minutes(events(spark, sf_dir), rules).write.parquet(folder)
    matched = schedules.match_rules(events(spark, sf_dir), rules, due=spark.read.parquet(folder))
    return matched.groupBy("cron", "event_type").agg(
        F.count("*").alias("events"), F.sum("event_id").alias("event_ids")
    )


@query
def a3_match_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = schedules.match_schedules(events(spark, sf_dir), fx.timetables(spark, sf_dir))
    return pairs.select("event_id", "timetable_uid")


@query
def a3_match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedules.match_summary(events(spark, sf_dir), fx.timetables(spark, sf_dir))


@query
def a4_fire_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedules.fire_times(schedules.active(fx.timetables(spark, sf_dir)), *MONTH)


@query
def a5_spawn_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, _ = schedules.planned_runs(fx.timetables(spark, sf_dir), fx.jobs(spark, sf_dir), *DAY)
    return runs.withColumn("options", map_text(F.col("options"))).withColumn(
        "jobconf", F.array_join("jobconf", " ")
    )


@query
def a5_spawn_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    timetables = fx.timetables(spark, sf_dir)
    fires = schedules.fire_times(timetables, *DAY)
    runs, _ = schedules.spawn_runs(fires, timetables, fx.jobs(spark, sf_dir))
    return runs.select("timetable_uid", "name", "createtime", "template_job_uid", "jar")


@query
def a5_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, log = schedules.planned_runs(fx.timetables(spark, sf_dir), fx.jobs(spark, sf_dir), *DAY)
    return log


# -- B: job queue and run history ----------------------------------------------


@query
def b1_derive_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    submitted = fx.table(spark, sf_dir, "orders").select(
        key.alias("uid"), (key % 7 - 2).alias("delay"), clean.exact_ms("o_orderdate").alias("now")
    )
    return queue.derive_submission(submitted, F.col("now")).drop("now", "delay")


@query
def b2_list_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = queue.list_by_status(fx.jobs(spark, sf_dir), "ready", queue.JOB_LISTING)
    return listed.select("uid", "status", "createtime")


@query
def b2_list_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = queue.list_by_status(fx.jobs(spark, sf_dir), "no such status", limit=0)
    return listed.select("uid", "status", "createtime")


@query
def b2_list_timetables(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = queue.list_by_status(fx.timetables(spark, sf_dir), "paused", statuses=queue.TIMETABLE_STATUSES)
    return listed.select("uid", "status", "createtime")


@query
def b2_list_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.list_by_status(fx.templates(spark, sf_dir), statuses=()).select("uid", "createtime")


@query
def b3_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = queue.list_enabled(fx.timetables(spark, sf_dir)).select(F.col("job_uid").alias("uid"))
    return queue.lookup(fx.jobs(spark, sf_dir), wanted).select("uid", "name", "status")


@query
def b4_runnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.runnable(fx.jobs(spark, sf_dir), NOW_MS).select("uid", "status", "priority")


@query
def b4_runnable_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.runnable(fx.jobs(spark, sf_dir), NOW_MS, 100).select("uid", "status", "priority")


@query
def b5_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = fx.jobs(spark, sf_dir)
    waiting = jobs.filter(queue.is_runnable(NOW_MS))
    admitted = queue.admit(waiting, queue.running(jobs), 700)
    return admitted.select("uid", "pool", "priority")


@query
def b5_admit_by_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = fx.jobs(spark, sf_dir)
    waiting = jobs.filter(queue.is_runnable(NOW_MS))
    running = queue.running(jobs)
    tracked = running.filter(F.col("starttime") <= NOW_MS)
    down = jobs.filter(F.col("pool") == 7).select("pool")
    admitted = queue.admit(waiting, running, POOL_SLOTS, tracked=tracked, down=down)
    return admitted.select("uid", "pool", "priority")


@query
def b5_admit_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole queue as one pool."""
    jobs = fx.jobs(spark, sf_dir)
    waiting = jobs.filter(queue.is_runnable(NOW_MS))
    return queue.admit(waiting, queue.running(jobs), GLOBAL_SLOTS, pool_col=None).select("uid", "pool", "priority")


@query
def b5_admit_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots from a table: a tenth of what waits in a pool, beyond what runs there."""
    jobs = fx.jobs(spark, sf_dir)
    waiting, running = jobs.filter(queue.is_runnable(NOW_MS)), queue.running(jobs)
    waits = waiting.groupBy("pool").agg(F.floor(F.count("*") / 10).alias("extra"))
    runs = running.groupBy("pool").agg(F.count("*").alias("running"))
    slots = waits.join(runs, "pool", "left").select("pool", (F.col("extra") + F.coalesce("running", F.lit(0))).alias("slots"))
    return queue.admit(waiting, running, slots).select("uid", "pool", "priority")


@query
def b6_replay_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.replay_transitions(
        fx.job_transitions(events(spark, sf_dir)), history.JOB_MACHINE
    )


@query
def b6_replay_timetables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.replay_transitions(
        fx.timetable_transitions(events(spark, sf_dir)), history.TIMETABLE_MACHINE
    )


@query
def b7_close_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.close_stale(fx.jobs(spark, sf_dir)).select("uid", "status")


@query
def b8_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = records.run_stats(
        fx.timetables(spark, sf_dir), fx.timetable_stats(events(spark, sf_dir))
    )
    return counted.select("uid", "jobs", "last_time", "last_job_uid")


@query
def b9_enrich_timetables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.enrich_timetables(fx.timetables(spark, sf_dir), fx.jobs(spark, sf_dir))
    return rows.select(
        "uid", "cron", F.col("job.uid").alias("job_uid"), F.col("job.name").alias("job_name"),
        F.col("job.status").alias("job_status"), F.col("job.finishtime").alias("job_finishtime"),
    )


@query
def b10_list_enabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.list_enabled(fx.timetables(spark, sf_dir)).select("uid", "status", "cron")


@query
def b11_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.running(fx.jobs(spark, sf_dir)).select("uid", "starttime", "sparkappid")


@query
def b12_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.elapsed(fx.jobs(spark, sf_dir), NOW_MS)
    return rows.select("uid", "elapsed_ms", "elapsed_label", "age")


@query
def b13_expand_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.expand_templates(fx.templates(spark, sf_dir)).drop("content", "name", "fields")


@query
def b13_template_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    expanded = records.expand_templates(fx.any_templates(spark, sf_dir))
    return expanded.select("uid", map_text(F.col("fields")).alias("fields"))


@query
def b14_delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = fx.timetables(spark, sf_dir).select(F.col("job_uid").alias("uid"))
    return queue.delete_by_key(fx.jobs(spark, sf_dir), used).select("uid", "name")


@query
def b15_job_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.to_documents(fx.jobs(spark, sf_dir).drop("pool"), "job")


@query
def b15_timetable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = records.run_stats(
        fx.timetables(spark, sf_dir), fx.timetable_stats(events(spark, sf_dir))
    )
    job = fx.jobs(spark, sf_dir).drop("pool")
    return records.to_documents(
        records.enrich_timetables(counted, job).select("uid", "name", "status", "canceltime", "cron",
                                                       "job", "jobs", "last_time", "last_job_uid"),
        "timetable",
    )


@query
def b15_template_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.to_documents(fx.templates(spark, sf_dir), "template").drop("status")


@query
def b15_template_any_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.to_documents(fx.any_templates(spark, sf_dir), "template").drop("status")


# -- C: cluster and application status -----------------------------------------


@query
def c1_parse_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.parse_apps(fx.app_snapshots(events(spark, sf_dir)))


@query
def c2_running_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    apps = status.running_apps_of(fx.app_snapshots(events(spark, sf_dir)))
    return apps.select("snapshot_id", "app_id", "app_name")


@query
def c2_running_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.transform(status.running_column(F.col("body")), lambda a: a["app_id"])
    return fx.app_snapshots(events(spark, sf_dir)).select(
        "snapshot_id", F.array_join(listed, ",").alias("apps")
    )


@query
def c3_cluster_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.cluster_status(fx.app_snapshots(events(spark, sf_dir))).drop("body")


@query
def c4_html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = html.html_elements(fx.table(spark, sf_dir, "pages"))
    return elements.groupBy("page_id", "tag").agg(F.count("*").alias("elements"))


@query
def c4_settings_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("page_id", "elem_id", "parent_id", "depth", "data", "balanced")
    cells = html.html_elements(fx.environment_pages(spark, sf_dir), "app_id", tags=("td",), columns=columns)
    return cells.withColumnRenamed("page_id", "app_id")


@query
def c5_html_value_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.page_values(fx.environment_pages(spark, sf_dir), {"value": "spark.tickloom.jobId"}, "app_id")
    return found.filter("size(found) > 0").drop("found")


@query
def c5_value_of_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from element rows."""
    elements = html.html_elements(fx.environment_pages(spark, sf_dir), "app_id", columns=("page_id", "elem_id", "parent_id", "data"))
    return html.html_value_for(elements, "spark.tickloom.jobId").withColumnRenamed("page_id", "app_id")


@query
def c6_link_apps_to_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fx.environment_pages(spark, sf_dir)
    return html.link_apps_to_jobs(pages.select("app_id", "completed"), pages.select("app_id", "html"))


# -- D: logs and text ----------------------------------------------------------


@query
def d1_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.page_count(documents(spark, sf_dir), "text", 500).drop("text")


@query
def d2_read_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    for name, (pos, offset) in {"ahead": (500, 100), "back": (500, -100), "low": (-20, 50), "out": (10**6, 9)}.items():
        rows = logs.read_range(rows, "text", pos, offset).withColumn(name, F.hex("block"))
    return rows.drop("text", "block")


def hex_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("block", F.hex("block"))


@query
def d3_pages_from_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hex_pages(logs.paginate(documents(spark, sf_dir), "text", 500, 100, "start"))


@query
def d4_pages_from_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hex_pages(logs.paginate(documents(spark, sf_dir), "text", 500, 100, "end"))


@query
def d4_last_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = logs.read_page(documents(spark, sf_dir), "text", 1, 500, 100, "end")
    third = logs.read_page(last.withColumnRenamed("block", "last"), "text", 3, 500, 100, "end")
    return third.select("doc_id", F.hex("last").alias("last"), F.hex("block").alias("third"))


@query
def d5_page_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.page_nav(logs.paginate(documents(spark, sf_dir), "text", 2000)).drop("block")


@query
def d6_replace_in_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.replace_in_lines(documents(spark, sf_dir), "text", "the", "[.*]")


# -- E: file inventory ---------------------------------------------------------


@query
def e1_list_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.list_children(fx.inventory(spark, sf_dir), extensions=(".html",))


@query
def e1_rejected_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.rejected_paths(fx.mixed_paths(spark, sf_dir)).select("page_id", "reason")


@query
def e1_list_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories of the inventory that hold nothing are listed too."""
    return inventory.list_children(fx.mixed_paths(spark, sf_dir)).select("path", "isdir")


@query
def e2_breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inventory.breadcrumbs(fx.inventory(spark, sf_dir))
    crumbs = F.transform("crumbs", lambda c: F.concat(c["name"], F.lit(":"), c["path"]))
    return rows.select("page_id", F.array_join(crumbs, " > ").alias("crumbs"))


@query
def e3_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.inventory(spark, sf_dir)
    return rows.select("page_id", paths.within("path", "/spam-farm.example.org/en").alias("inside"),
                       paths.within("path", "/spam-farm.example.org/e").alias("prefix_only"))


# -- F: column cleaning --------------------------------------------------------


@query
def f1_json_or_else(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = T.StructType([T.StructField("k", T.LongType())])
    props = F.col("props")
    text = (
        F.when(F.col("event_id") % 4 == 1, F.substring(props, F.lit(1), F.length(props) - 1))
        .when(F.col("event_id") % 4 == 2, F.lit(None))
        .otherwise(props)
    )
    default = F.struct(F.lit(-1).cast("bigint").alias("k"))
    return events(spark, sf_dir).select("event_id", clean.json_or_else(text, schema, default)["k"].alias("k"))


@query
def f1_json_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored JSON with tails, words that are no JSON, other quotes, repeated keys and spaces around it."""
    key = F.col("p_partkey")
    value = F.concat(F.lit('{"k":'), key, F.lit(',"s":"'), "p_name", F.lit('"}'))
    text = (
        F.when(key % 9 == 0, F.concat(value, F.lit(" tail"))).when(key % 9 == 1, F.concat(value, value))
        .when(key % 9 == 2, F.concat(value, F.lit(","), value)).when(key % 9 == 3, F.concat(value, F.lit("}")))
        .when(key % 9 == 4, F.lit('{"k":NaN}')).when(key % 9 == 5, F.translate(value, '"', "'"))
        .when(key % 9 == 6, F.concat(F.lit('{"k":0,'), F.substr(value, F.lit(2)))).when(key % 9 == 7, F.concat(F.lit(" \n"), value, F.lit("\t ")))
        .otherwise(value)
    )
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("s", T.StringType())])
    default = F.struct(F.lit(-1).cast("bigint").alias("k"), F.lit("none").alias("s"))
    parsed = clean.json_or_else(text, schema, default)
    return fx.table(spark, sf_dir, "part").select("p_partkey", clean.is_json(text).alias("whole"), parsed["k"].alias("k"), parsed["s"].alias("s"))


@query
def b5_admit_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by name, every fifth without a priority, few priorities for the others."""
    jobs = fx.jobs(spark, sf_dir)
    urgent = F.when(F.col("uid") % 5 != 2, F.col("uid") % 3)
    waiting = jobs.filter(queue.is_runnable(NOW_MS)).select(
        F.concat(F.lit("job-"), F.col("uid") % 1000, F.lit("-"), "uid").alias("uid"), "pool", urgent.alias("priority"))
    return queue.admit(waiting, queue.running(jobs), 700)


@query
def f2_int_or_else(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = ("%s", " %s ", "+%s", "-%s", "%sabs", "%s.5", "%sL", "")
    kind = F.col("event_id") % len(shapes)
    text = F.replace(fx.pick(shapes, kind), F.lit("%s"), F.col("event_id").cast("string"))
    return events(spark, sf_dir).select("event_id", clean.int_or_else(text, -7).alias("number"))


@query
def f3_bool_or_else(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ("true", "TRUE", "1", "Yes", "false", "0", "No", "", "t", "f", "2", " ")
    kind = F.col("event_id") % (len(words) + 1)
    return events(spark, sf_dir).select(
        "event_id", clean.bool_or_else(fx.pick(words, kind), False).alias("flag")
    )


@query
def f4_parse_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.submissions(spark, sf_dir).select(
        "uid",
        F.array_join(clean.parse_args("options"), "|").alias("args"),
        F.array_join(clean.parse_args("jobconf"), "|").alias("jobconf"),
        map_text(clean.parse_options("options")).alias("options"),
    )


@query
def f5_job_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("options", F.lit(" spark.driver.memory=9g"))
    merged = clean.job_options(text, F.col("dmemory"), F.col("ememory"))
    return fx.submissions(spark, sf_dir).select("uid", map_text(merged).alias("options"))


@query
def f6_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = quality.tag_violations(fx.submissions(spark, sf_dir), quality.job_rules())
    return tagged.select("uid", F.array_join("violations", ",").alias("violations"))


@query
def f6_violation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, counts = quality.validate(fx.submissions(spark, sf_dir), quality.job_rules())
    return counts


@query
def f6_timetable_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of timetables: status and times."""
    rows = fx.timetables(spark, sf_dir).select(
        "uid", F.when(F.col("uid") % 6 == 1, F.lower("status")).otherwise(F.col("status")).alias("status"),
        (F.col("uid") % 4 - 1).alias("createtime"))
    tagged = quality.tag_violations(rows, quality.timetable_rules())
    return tagged.select("uid", F.array_join(F.array_sort("violations"), ",").alias("violations"))


@query
def f6_address_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same addresses as every kind of address."""
    tagged = quality.tag_violations(fx.addresses(spark, sf_dir), quality.address_rules("address", "address", "address"))
    return tagged.select("uid", F.array_join("violations", ",").alias("violations"))


@query
def f7_parse_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = clean.parse_uri("address")
    return fx.addresses(spark, sf_dir).select(
        "uid", uri["host"].alias("host"), uri["port"].alias("port"),
        uri["database"].alias("database"), uri["user"].alias("user"),
        clean.is_master_url("address").alias("is_master"),
        clean.is_ui_url("address").alias("is_ui"), clean.is_jdbc_url("address").alias("is_jdbc"),
    )


@query
def f8_canonical_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.templates(spark, sf_dir).select("uid", clean.canonical_name("name", "uid").alias("name"))


@query
def f9_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = clean.exact_ms("ts")
    return events(spark, sf_dir).select(
        "event_id", clean.ts_to_ms("ts").alias("ms"), clean.ms_to_ts(ms).alias("ts")
    )


# -- S: sources, sinks, streams ------------------------------------------------


def stored_tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The named tables written to a folder of tables, and read back."""
    folder = scratch_dir(spark)
    made = {
        "job": fx.jobs(spark, sf_dir).drop("pool"),
        "timetable": fx.timetables(spark, sf_dir),
        "timetable_stats": fx.timetable_stats(events(spark, sf_dir)),
        "template": fx.templates(spark, sf_dir),
    }
    for name in names:
        made[name].write.parquet(f"{folder}/{name}")
    return stored.read_tables(spark, folder, names=names)


def check_sum(col: str) -> Column:
    """The sum of a bigint column, exact where a bigint holds it and modulo 2^64 beyond; 5.4 million times of today are beyond."""
    total = F.sum(F.col(col).cast("decimal(19,0)"))  # exact for 10^10 rows of any value
    half, whole = (F.lit(n).cast("decimal(38,0)") for n in (str(1 << 63), str(1 << 64)))
    return (F.pmod(total + half, whole) - half).cast("bigint")


@query
def s1_read_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table and a check sum of their times."""
    parts = [
        rows.agg(F.count("*").alias("rows"), check_sum("createtime").alias("createtimes"))
        .withColumn("table", F.lit(name))
        for name, rows in stored_tables(spark, sf_dir, *stored.SCHEMAS).items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def s1_read_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored_tables(spark, sf_dir, "job")["job"]
    return rows.withColumn("options", map_text(F.col("options"))).withColumn("jobconf", F.array_join("jobconf", " "))


@query
def s1_read_timetables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_tables(spark, sf_dir, "timetable")["timetable"]


@query
def s1_read_timetable_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_tables(spark, sf_dir, "timetable_stats")["timetable_stats"]


@query
def s1_read_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_tables(spark, sf_dir, "template")["template"]


@query
def s2_write_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark)
    stored.write_metadata(fx.jobs(spark, sf_dir), folder)
    back = stored.read_metadata(spark, folder)
    return back.withColumn("options", map_text(F.col("options"))).withColumn(
        "jobconf", F.array_join("jobconf", " ")
    )


def land_logs(texts: DataFrame, folder: str) -> None:
    """Each document as the stdout file of a job, written by the tasks that hold it."""

    def write(batches):
        system, base = log_files.file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                system.create_dir(f"{base}/job-{row['doc_id']}", recursive=True)
                with system.open_output_stream(f"{base}/job-{row['doc_id']}/stdout") as out:
                    out.write(row["text"].encode())
            yield pa.RecordBatch.from_pydict({"written": [batch.num_rows]})

    spread(texts, "doc_id").mapInArrow(write, "written bigint").agg(F.sum("written")).collect()


@query
def s3_read_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark)
    land_logs(documents(spark, sf_dir), folder)
    whole = log_files.read_logs(spark, folder)
    return whole.select("uid", "type", "length", F.md5("content").alias("digest"))


@query
def s3_read_log_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark)
    land_logs(documents(spark, sf_dir), folder)
    jobs = documents(spark, sf_dir).select(F.col("doc_id").alias("uid"))
    return hex_pages(logs.page_nav(log_files.read_log_pages(spark, folder, 4096, jobs=jobs)))


@query
def s3_pages_from_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark)
    land_logs(documents(spark, sf_dir), folder)
    return hex_pages(log_files.read_log_pages(spark, folder, 4096, origin="end"))


@query
def s3_read_one_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of every log; some logs do not have it."""
    folder = scratch_dir(spark)
    land_logs(documents(spark, sf_dir), folder)
    asked = documents(spark, sf_dir).select(F.col("doc_id").alias("uid"), F.lit("stdout").alias("type"), (F.col("doc_id") % 3 + 1).alias("page"))
    return hex_pages(log_files.read_log_pages(spark, folder, 4096, requests=asked))


@query
def s3_empty_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both readers over logs of which some are empty."""
    folder = scratch_dir(spark)
    text = F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.col("text"))
    land_logs(documents(spark, sf_dir).withColumn("text", text), folder)
    pages = log_files.read_log_pages(spark, folder, 4096).groupBy("uid", "type").agg(
        F.count("*").alias("pages"), F.max("page_count").alias("page_count"))
    return log_files.read_logs(spark, folder).select("uid", "type", "length").join(pages, ["uid", "type"])


def landed(rows: DataFrame) -> DataFrame:
    """What a stream appends until its source is read up."""
    spark, folder = rows.sparkSession, scratch_dir(rows.sparkSession)
    streams.append_rows(rows, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


@query
def s4_cron_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = schedules.cron_filter(event_stream(spark, sf_dir), "ts", OFFICE_HOURS)
    return landed(due.select("event_id", "ts"))


@query
def s5_spawn_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark)
    streams.follow_due_runs(
        event_batches(spark, sf_dir), fx.timetables(spark, sf_dir), fx.jobs(spark, sf_dir),
        folder, f"{folder}/checkpoint",
    ).awaitTermination()
    runs = ledger.read(spark, f"{folder}/runs")
    log = ledger.read(spark, f"{folder}/log").select("timetable_uid", "createtime", "job_name")
    wanted = runs.select("timetable_uid", "name", "status", "createtime", "priority", "entrypoint")
    # a timetable's runs of some 25 days lie together
    return packed_join(wanted, log, ["timetable_uid", "createtime"], [F.col("timetable_uid"), F.shiftright("createtime", 31)])


def followed(spark: SparkSession, rows: DataFrame, machine: history.Machine) -> DataFrame:
    folder = scratch_dir(spark)
    streams.follow_transitions(
        rows, machine, f"{folder}/states", f"{folder}/checkpoint"
    ).awaitTermination()
    return streams.states_now(spark, f"{folder}/states").drop("late")


@query
def s6_job_status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return followed(spark, fx.job_transitions(event_batches(spark, sf_dir)), history.JOB_MACHINE)


@query
def s6_timetable_status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.timetable_transitions(event_batches(spark, sf_dir))
    return followed(spark, rows, history.TIMETABLE_MACHINE)


@query
def s7_run_stats_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark)
    runs = fx.timetable_stats(event_batches(spark, sf_dir))
    streams.follow_run_totals(runs, f"{folder}/totals", f"{folder}/checkpoint").awaitTermination()
    return ledger.read_latest(spark, f"{folder}/totals", "timetable_uid")


@query
def s8_cluster_status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    polls = fx.app_snapshots(event_stream(spark, sf_dir))
    return landed(status.cluster_status(polls).drop("body"))


# -- flows ---------------------------------------------------------------------


@query
def flow_admission_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    admitted = flows.admission_round(
        fx.submissions(spark, sf_dir), queue.running(fx.jobs(spark, sf_dir)), 1500, NOW_MS
    )
    return admitted.select("uid", "pool", "status", "submittime", "priority")


@query
def flow_log_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = flows.log_pages(documents(spark, sf_dir), "text")
    return pages.withColumn("block", F.md5("block"))
