"""Schedule and job tables derived from the given test tables.

All are projections of one table, evaluated by Spark with the table's own size; none
collects, samples or limits. ``plans/sql.py`` states the same tables in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.clean import exact_ms
from tickloom.operators.queue import derive_submission

CREATED_MS = 1_704_067_200_000  # 2024-01-01

# Rules of the timetables by uid % 8; rule 0 depends on the uid, see cron_of.
RULES = (
    None,
    "*/15 8-17 * * MON-FRI *",
    "0 0,12 1 */2 * *",
    "0 9 * * * 2024",
    "0 12 * * Mon-Fri *",
    "45 17 7 6 * 2015,2016",
    "30 */6 1,15,31 Jan * *",
    "5,35 0-5 * * SAT,7 *",
)

# Good and bad rules for the parser by uid % 26.
PARSER_RULES = (
    "* * * * * *",
    "0 9 1 * 1 2015",
    "59 23 31 DEC Fri *",
    "59 23 31 12 5 *",
    "0 0,12 1 */2 * *",
    "*/15 */6 1,15,31 * 1-5 *",
    "0,15,30,45 0,6,12,18 1,15,31 * 1-5 *",
    "0 12 * * Mon-Fri *",
    "  5   7  *\t* sun,1,WED 2014-2031 ",
    "007 */+5 31,1,1 jan,2 * 2031",
    "*/100 * * * * *",
    "* * * *",
    "* 1,2,3-10 * * * *",
    "* * 0-10 * * 2015",
    "* * 1-31 Jan-Tes * 2015",
    "t b 11 9 * 2015",
    "123",
    "0-30/5 * * * * *",
    "*/-5 * * * * *",
    "*/0 * * * * *",
    "* * */40 * * *",
    "* 5-1 * * * *",
    "* * * 1-FEB * *",
    "* * * * 8 *",
    "* * * * * 2032",
    "JAN * * * * *",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(choices: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in choices]), index.cast("int"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of all statuses, one per order."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    created = exact_ms("o_orderdate") + (key % 86400) * 1000
    base = table(spark, sf_dir, "orders").select(
        key.alias("uid"),
        (F.col("o_custkey") % 8).alias("pool"),
        F.concat(F.lit("job-"), key).alias("name"),
        F.when(status == "O", (key % 5) * 600).otherwise(F.lit(0)).alias("delay"),
        created.alias("createtime"),
        status.alias("_kind"),
        F.col("o_orderpriority").alias("_urgency"),
        F.floor("o_totalprice").alias("_price"),
    )
    derived = derive_submission(base, F.col("createtime"))
    kind = F.col("_kind")
    status = (
        F.when(kind == "O", F.col("status"))
        .when(kind == "P", F.lit("RUNNING"))
        .when(F.col("_urgency") == "5-LOW", F.lit("CLOSED"))
        .otherwise(F.lit("FINISHED"))
    )
    started = F.when(F.col("status").isin("RUNNING", "FINISHED"), F.col("submittime") + 60000)
    finished = F.when(F.col("status") == "FINISHED", F.col("starttime") + F.col("_price"))
    return (
        derived.withColumn("status", status)
        .withColumn("starttime", started)
        .withColumn("finishtime", finished)
        .select(
            "uid", "pool", "name", "status", "createtime", "submittime", "starttime",
            "finishtime", "priority",
            F.when(F.col("status") == "RUNNING", F.concat(F.lit("app-"), "uid")).alias("sparkappid"),
            F.concat(F.lit("com.test.J"), F.col("uid") % 100).alias("entrypoint"),
            F.concat(F.lit("/tmp/job-"), F.col("uid") % 10, F.lit(".jar")).alias("jar"),
            F.create_map(
                F.lit("spark.driver.memory"), F.concat(F.col("uid") % 7 + 1, F.lit("g")),
                F.lit("spark.executor.memory"), F.lit("4g"),
            ).alias("options"),
            F.array(F.lit("--key"), F.col("uid").cast("string")).alias("jobconf"),
        )
    )


def cron_of(uid: Column) -> Column:
    daily = F.concat_ws(" ", uid % 60, uid % 24, F.lit("* * * *"))
    return (
        F.when(uid % 500 == 8, F.lit("* * * * * *"))
        .when(uid % 8 == 0, daily)
        .otherwise(pick(tuple(r or "" for r in RULES), uid % 8))
    )


def timetables(spark: SparkSession, sf_dir: str) -> DataFrame:
    uid = F.col("c_custkey")
    cancelled = uid % 10 == 0
    status = (
        F.when(cancelled, F.lit("CANCELLED"))
        .when((uid % 10).isin(1, 2), F.lit("PAUSED"))
        .otherwise(F.lit("ACTIVE"))
    )
    return table(spark, sf_dir, "customer").select(
        uid.alias("uid"),
        F.col("c_name").alias("name"),
        status.alias("status"),
        F.lit(CREATED_MS).cast("bigint").alias("createtime"),
        F.when(cancelled, F.lit(CREATED_MS + 86_400_000).cast("bigint")).alias("canceltime"),
        cron_of(uid).alias("cron"),
        uid.alias("job_uid"),
    )


def parser_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    uid = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        uid.alias("uid"), pick(PARSER_RULES, uid % len(PARSER_RULES)).alias("cron")
    )


def timetable_stats(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("timetable_uid"),
        F.col("event_id").alias("job_uid"),
        exact_ms("ts").alias("createtime"),
    )


def job_transitions(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    action = (
        F.when(kind.isin("view", "click"), F.lit("run"))
        .when(kind == "purchase", F.lit("finish"))
        .when(kind == "error", F.lit("close"))
    )
    return events.select(
        (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("key"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("event_id").alias("seq"),
        action.alias("action"),
    )


def timetable_transitions(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    action = (
        F.when(kind.isin("click", "purchase"), F.lit("pause"))
        .when(kind.isin("view", "signup"), F.lit("resume"))
        .when((kind == "error") & (F.col("value") > 150), F.lit("cancel"))
    )
    return events.select(
        F.col("user_id").alias("key"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("event_id").alias("seq"),
        action.alias("action"),
    )


def app_snapshots(events: DataFrame) -> DataFrame:
    """One status snapshot per event; bodies of all kinds, also missing and broken ones."""
    kind = F.col("_kind")
    done = F.when(F.col("event_type") == "purchase", F.lit("true")).otherwise(F.lit("false"))

    def app(n: int, *completed: Column) -> Column:
        attempts = [F.concat(F.lit('{"completed":'), c, F.lit("}")) for c in completed]
        return F.concat(
            F.lit('{"id":"app-'), F.col("event_id"), F.lit(f'-{n}","name":"u'), F.col("user_id"),
            F.lit('","attempts":['), F.concat_ws(",", *attempts), F.lit("]}"),
        )

    def array(*apps: Column) -> Column:
        return F.concat(F.lit("["), F.concat_ws(",", *apps), F.lit("]"))

    body = (
        F.when(kind == 1, F.lit("[]"))
        .when(kind == 2, F.lit('{"key":}'))
        .when(kind == 3, array(F.lit('{"id":"x","name":"y"}'), app(0, done)))
        .when(kind == 4, array(app(0)))
        .when(kind >= 5, array(app(0, done, F.lit("true")), app(1, F.lit("true"))))
    )
    kinds = events.withColumn("_kind", F.get_json_object("props", "$.k").cast("int") % 10)
    return kinds.select(F.col("event_id").alias("snapshot_id"), body.alias("body"))


def environment_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One settings page per job; some lack a key, some put the value first."""
    uid, name = F.col("uid"), F.col("name")

    def row(*cells: Column) -> Column:
        return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells],
                        F.lit("</tr>\n"))

    app = F.concat(F.lit("app-"), uid)
    app_row = F.when(uid % 7 == 3, F.lit("")).otherwise(row(F.lit("spark.app.id"), app))
    job_row = F.when(
        uid % 5 == 2, row(uid.cast("string"), F.lit("spark.tickloom.jobId"))
    ).otherwise(row(F.lit("  spark.tickloom.jobId\n"), uid.cast("string")))
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><meta charset=utf-8><link rel=x></head><body>"
              "<h3>Environment</h3><div><table><tbody>\n"),
        row(F.lit("spark.app.name"), name), app_row, job_row,
        F.lit("</tbody></table></div></body></html>"),
    )
    return jobs(spark, sf_dir).select(
        F.coalesce("sparkappid", app).alias("app_id"),
        (F.col("status") != "RUNNING").alias("completed"),
        html.alias("html"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", "/"), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_replace(path, "/$", "").alias("path")
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    memory = F.concat(size, pick(("g", "mb", "M", "b", "gigabytes"), key % 5))
    flawed = F.when(key % 7 == 0, F.lit("-x")).otherwise(F.lit(""))
    return table(spark, sf_dir, "part").select(
        key.alias("uid"),
        (key % 8).alias("pool"),
        F.col("p_name").alias("name"),
        F.lit("READY").alias("status"),
        (key + 1).alias("createtime"),
        (key + 1).alias("submittime"),
        (key - 3).alias("priority"),
        memory.alias("dmemory"),
        memory.alias("ememory"),
        F.concat(F.lit("com.test.P"), key, flawed).alias("entrypoint"),
        F.concat(F.lit("/tmp/"), key, pick((".jar", ".JAR", ".txt"), key % 3)).alias("jar"),
        F.concat(
            F.lit("a="), size, F.lit(' name="'), "p_name", F.lit('" --flag a=2'),
            F.when(key % 11 == 5, F.lit(" 'open")).otherwise(F.lit("")),
        ).alias("options"),
        F.concat(F.lit("x\\ y 'it is' "), size).alias("jobconf"),
        ((key % 4 - 1) * 60).cast("string").alias("delay"),
    )


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.to_json(
        F.struct("name", "entrypoint", "dmemory", "ememory", "options", "jobconf", "delay", "jar")
    )
    uid = F.col("uid")
    return submissions(spark, sf_dir).select(
        uid,
        F.when(uid % 9 == 0, F.lit("  ")).otherwise(F.col("name")).alias("name"),
        (uid + 1).alias("createtime"),
        F.when(uid % 13 == 6, F.lit("{broken")).otherwise(content).alias("content"),
    )


def any_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates whose content has keys of its own kind."""
    uid = F.col("uid")
    content = F.concat(F.lit('{"key":"'), "name", F.lit('","n":'), uid, F.lit(',"deep":{"list":[1,'), uid % 7, F.lit("]}}"))
    return submissions(spark, sf_dir).select(
        uid, F.lit("any").alias("name"), (uid + 1).alias("createtime"),
        F.when(uid % 13 == 6, F.lit("{broken")).otherwise(content).alias("content"))


def mixed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory with relative paths, empty parts, directories and missing paths among it."""
    kind, path = F.col("page_id") % 5, F.col("path")
    return inventory(spark, sf_dir).withColumn(
        "path", F.when(kind == 1, F.substring(path, 2, 1 << 20)).when(kind == 2, F.concat(F.lit("/"), path))
        .when(kind == 3, F.concat(path, F.lit("/"))).when(kind == 0, path))


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Master, UI and JDBC addresses, a part of them wrong."""
    key = F.col("s_suppkey")
    host = F.concat(F.lit("node-"), key, F.lit(".example.org"))
    plain_host = F.concat(F.lit("db"), key, F.lit(".example.org"))
    address = (
        F.when(key % 5 == 0, F.concat(F.lit("spark://"), host, F.lit(":7077")))
        .when(key % 5 == 1, F.concat(F.lit("http://"), host, F.lit(":"), 8000 + key % 1000))
        .when(key % 5 == 2, F.concat(F.lit("https://"), host, F.lit(":8443")))
        .when(key % 5 == 3, F.concat(F.lit("jdbc:mysql://"), plain_host,
                                     F.lit(":3306/main?user=u&password=p$1")))
        .otherwise(F.concat(F.lit("spark://"), host))
    )
    return table(spark, sf_dir, "supplier").select(key.alias("uid"), address.alias("address"))
