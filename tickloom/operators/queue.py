"""The job queue: submission, listings, admission under a slot limit."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.clean import JOB_STATUSES, TIMETABLE_STATUSES, floor_div, int_or_else

# Rows of the job listing.
JOB_LISTING = 100
# Parts of a pool that meet its short tables in different tasks.
SALTS = 8
# Places a pool's queue is cut at to find the job its slots end at, the jobs drawn to choose them, and every how many
# cuts a job is compared with first.
CUTS, SAMPLE, STRIDE = 144, 2048, 12


def _now(now: int | Column) -> Column:
    return F.lit(now).cast("bigint") if isinstance(now, int) else now


def derive_submission(df: DataFrame, now: int | Column, delay_col: str = "delay") -> DataFrame:
    """createtime, submittime, status and priority of jobs submitted at ``now`` (ms).

    A delay of up to one second still means READY. Delayed jobs get a priority in
    seconds, which puts them before every ready job once they are due.
    """
    delay = F.col(delay_col)
    if isinstance(df.schema[delay_col].dataType, T.StringType):
        delay = int_or_else(delay, 0)
    delay = F.greatest(F.coalesce(delay.cast("bigint"), F.lit(0)), F.lit(0))
    created, submit = F.col("createtime"), F.col("submittime")
    late = submit > created + 1000
    return (
        df.withColumn("createtime", _now(now))
        .withColumn("submittime", created + delay * 1000)
        .withColumns(
            {
                "status": F.when(late, F.lit("DELAYED")).otherwise(F.lit("READY")),
                "priority": F.when(late, floor_div(submit, 1000)).otherwise(submit),
            }
        )
    )


def list_by_status(
    df: DataFrame,
    status: str | None = None,
    limit: int = 0,
    statuses: tuple[str, ...] = JOB_STATUSES,
) -> DataFrame:
    """Newest first; an unknown status filters nothing; limit 0 or less gives all rows.

    ``statuses`` are the known ones; timetables have others than jobs, templates none.
    The listing of jobs shows the newest ``JOB_LISTING``; the others are listed whole.
    """
    wanted = (status or "").upper()
    if wanted in statuses:
        df = df.filter(F.col("status") == wanted)
    ordered = df.orderBy(F.desc("createtime"), F.asc("uid"))
    return ordered.limit(limit) if limit > 0 else ordered


def lookup(df: DataFrame, uids: DataFrame | int, uid_col: str = "uid") -> DataFrame:
    """Rows with the given keys: one number, or a table with the key column."""
    if isinstance(uids, int):
        return df.filter(F.col(uid_col) == uids)
    return df.join(uids.select(uid_col).distinct(), uid_col, "left_semi")


def delete_by_key(df: DataFrame, uids: DataFrame | int, uid_col: str = "uid") -> DataFrame:
    """The rows that remain once the given keys are gone."""
    if isinstance(uids, int):
        return df.filter(F.col(uid_col) != uids)
    return df.join(uids.select(uid_col).distinct(), uid_col, "left_anti")


def is_runnable(now: int | Column) -> Column:
    due = (F.col("status") == "DELAYED") & (F.col("submittime") <= _now(now))
    return (F.col("status") == "READY") | due


def runnable(jobs: DataFrame, now: int | Column, limit: int = -1) -> DataFrame:
    """READY jobs and DELAYED ones that are due, most urgent first.

    limit 0 gives none, a negative limit all.
    """
    ordered = jobs.filter(is_runnable(now)).orderBy("priority", "uid")
    return ordered if limit < 0 else ordered.limit(limit)


def running(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status") == "RUNNING")


def close_stale(jobs: DataFrame) -> DataFrame:
    """After a restart no process is known any more: RUNNING becomes CLOSED."""
    status = F.col("status")
    return jobs.withColumn("status", F.when(status == "RUNNING", "CLOSED").otherwise(status))


def list_enabled(timetables: DataFrame) -> DataFrame:
    return timetables.filter(F.col("status") != "CANCELLED")


def admit(
    queue: DataFrame,
    running_apps: DataFrame,
    capacity: int | Mapping | DataFrame,
    pool_col: str | None = "pool",
    tracked: DataFrame | None = None,
    down: DataFrame | None = None,
) -> DataFrame:
    """The most urgent queued jobs that fit the free slots of their pool, ranked as :func:`runnable` ranks them.

    free = capacity − running apps of the pool. A pool takes nothing if its jobs
    tracked here (rows of ``tracked``) fill the capacity, or if it is listed in
    ``down``. ``capacity`` is one number, {pool: number} or a table (pool, slots); a pool
    it does not list has none. Without ``pool_col`` the whole queue is one pool, and any row
    of ``down`` closes it. Rows without a pool are not admitted. A missing priority comes before all others, a missing
    uid before the others of its priority; uids may be of any type that has an order. Other columns come along, whatever
    their names.

    A sample of a pool's queue gives places to cut it at, parts between cuts are counted, parts that fit whole are
    admitted, and only the part in which the slots end is ranked. So no task sorts or holds a pool, whatever its size and
    capacity, and many jobs of one priority are cut by uid; the result is exact whatever the sample.
    """
    name = F.lit("") if pool_col is None else F.col(pool_col)
    at = F.struct("priority", "uid").alias("at")
    ranks = queue.select(name.alias("pool"), at).filter("pool IS NOT NULL")
    free = _free_slots(queue, ranks, name, running_apps, capacity, pool_col, tracked, down)
    cuts = _cuts(ranks, free)
    placed = _salted(ranks, cuts).select("pool", "free", _part(F.col("at")).alias("part"))
    counts = placed.groupBy("pool", "part").agg(F.count("*").alias("n"), F.max("free").alias("free"))
    before = F.sum("n").over(Window.partitionBy("pool").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    left = F.col("free") - F.coalesce(before, F.lit(0))
    ends = counts.withColumn("left", left).filter("left > 0").groupBy("pool").agg(F.max(F.struct("part", "left")).alias("end"))
    rows = queue.select(name.alias("pool"), at, F.struct("*").alias("row")).filter("pool IS NOT NULL")
    rows = _salted(rows, cuts.join(ends, "pool")).withColumn("part", _part(F.col("at"))).filter("part <= coalesce(end.part, -1)")
    # parts that fit whole need no rank: they are only dealt out evenly
    group = F.when(F.col("part") == F.col("end.part"), F.lit(-1)).otherwise(F.col("salt"))
    within = Window.partitionBy("pool", group).orderBy("at")
    ranked = rows.withColumn("rank", F.row_number().over(within))
    return ranked.filter("part < end.part OR rank <= end.left").select("row.*")


def _free_slots(queue, ranks, name, running_apps, capacity, pool_col, tracked, down) -> DataFrame:
    """(pool, free, n): the pools with jobs and free slots, and how many jobs wait in each."""

    def per_pool(rows: DataFrame, count: str) -> DataFrame:
        return rows.select(name.alias("pool")).groupBy("pool").agg(F.count("*").alias(count))

    free = ranks.groupBy("pool").agg(F.count("*").alias("n"))
    if isinstance(capacity, int):
        free = free.withColumn("slots", F.lit(capacity).cast("bigint"))
    else:
        if isinstance(capacity, Mapping):
            kind = "string" if pool_col is None else queue.schema[pool_col].dataType.simpleString()
            capacity = queue.sparkSession.createDataFrame(list(capacity.items()), f"pool {kind}, slots bigint")
        free = free.join(capacity.select("pool", F.col("slots").cast("bigint").alias("slots")), "pool")
    free = free.join(per_pool(running_apps, "apps"), "pool", "left")
    left = F.col("slots") - F.coalesce("apps", F.lit(0))
    if tracked is not None:
        free = free.join(per_pool(tracked, "tracked"), "pool", "left")
        left = F.when(F.coalesce("tracked", F.lit(0)) < F.col("slots"), left).otherwise(F.lit(0))
    if down is not None:
        free = free.join(down.select(name.alias("pool")).distinct(), "pool", "left_anti")
    return free.select("pool", left.alias("free"), "n").filter("free > 0")


def _cuts(ranks: DataFrame, free: DataFrame) -> DataFrame:
    """(pool, free, cuts, coarse): up to ``CUTS`` places in rank order that cut a pool's queue about evenly."""
    # the hash, a number of 40 bits, is below the pool's bound for about SAMPLE of its jobs
    drawn = F.pmod(F.xxhash64("at"), F.lit(1 << 40)) * F.col("n") < F.lit(float(SAMPLE << 40))
    # a pool without a sample is one part
    listed = _salted(ranks, free).groupBy("pool").agg(
        F.max("free").alias("free"), F.array_sort(F.collect_list(F.when(drawn, F.col("at")))).alias("sample"))
    spaced = F.filter("sample", lambda _, i: F.floor(i * CUTS / F.size("sample")) < F.floor((i + 1) * CUTS / F.size("sample")))
    cuts = listed.filter("free IS NOT NULL").select("pool", "free", spaced.alias("cuts"))
    return cuts.select("pool", "free", "cuts", F.filter("cuts", lambda _, i: (i + 1) % STRIDE == 0).alias("coarse"))


def _part(value: Column) -> Column:
    """How many of ``cuts`` come before a rank: first among every ``STRIDE``-th, then among those between."""
    above = F.size(F.filter("coarse", lambda b: b < value)) * STRIDE
    fine = F.slice("cuts", above + 1, STRIDE - 1)
    return F.coalesce(above + F.size(F.filter(fine, lambda b: b < value)), F.lit(0))


def _salted(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with what a short table says about their pool, if anything, met in ``SALTS`` parts per pool.

    A left join, so that Spark never gathers the rows to send them to the short table's few tasks.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(SALTS)))
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt")
    return salted.join(table.select("*", parts), ["pool", "salt"], "left")
