"""What each query must give, stated independently in SQL over the given tables."""

from __future__ import annotations

from tickloom.functions.clean import ADJECTIVES, NOUNS
from tickloom.plans.fixtures import RULES
from tickloom.plans.queries import NOW_MS, GLOBAL_SLOTS, POOL_SLOTS

JOBS = """
jobs0 AS (
  SELECT o_orderkey AS uid, o_custkey % 8 AS pool,
         epoch_ms(o_orderdate) + (o_orderkey % 86400) * 1000 AS createtime,
         CASE WHEN o_orderstatus = 'O' THEN (o_orderkey % 5) * 600 ELSE 0 END AS delay,
         o_orderstatus AS kind, o_orderpriority AS urgency,
         CAST(floor(o_totalprice) AS BIGINT) AS price
  FROM orders),
jobs1 AS (SELECT *, createtime + delay * 1000 AS submittime FROM jobs0),
jobs2 AS (
  SELECT *,
         CASE WHEN kind = 'P' THEN 'RUNNING'
              WHEN kind = 'F' AND urgency = '5-LOW' THEN 'CLOSED'
              WHEN kind = 'F' THEN 'FINISHED'
              WHEN submittime > createtime + 1000 THEN 'DELAYED' ELSE 'READY' END AS status,
         CASE WHEN submittime > createtime + 1000 THEN submittime // 1000
              ELSE submittime END AS priority
  FROM jobs1),
jobs AS (
  SELECT uid, pool, 'job-' || uid AS name, status, createtime, submittime,
         CASE WHEN status IN ('RUNNING', 'FINISHED') THEN submittime + 60000 END AS starttime,
         CASE WHEN status = 'FINISHED' THEN submittime + 60000 + price END AS finishtime,
         priority, CASE WHEN status = 'RUNNING' THEN 'app-' || uid END AS sparkappid,
         'com.test.J' || (uid % 100) AS entrypoint, '/tmp/job-' || (uid % 10) || '.jar' AS jar,
         'spark.driver.memory=' || (uid % 7 + 1) || 'g;spark.executor.memory=4g' AS options,
         '--key ' || uid AS jobconf
  FROM jobs2)"""

_CASES = "\n".join(f"WHEN c_custkey % 8 = {i} THEN '{r}'" for i, r in enumerate(RULES) if r)

TIMETABLES = f"""
timetables AS (
  SELECT c_custkey AS uid, c_name AS name,
         CASE WHEN c_custkey % 10 = 0 THEN 'CANCELLED'
              WHEN c_custkey % 10 IN (1, 2) THEN 'PAUSED' ELSE 'ACTIVE' END AS status,
         1704067200000 AS createtime,
         CASE WHEN c_custkey % 10 = 0 THEN 1704153600000 END AS canceltime,
         CASE WHEN c_custkey % 500 = 8 THEN '* * * * * *'
              WHEN c_custkey % 8 = 0 THEN (c_custkey % 60) || ' ' || (c_custkey % 24) || ' * * * *'
              {_CASES} END AS cron,
         c_custkey AS job_uid
  FROM customer),
due AS (SELECT * FROM timetables WHERE status = 'ACTIVE')"""

STATS = """
stats AS (SELECT user_id AS timetable_uid, event_id AS job_uid, epoch_us(ts) // 1000 AS createtime FROM events),
totals AS (
  SELECT timetable_uid, count(*) AS jobs, max(createtime) AS last_time,
         max(job_uid) FILTER (createtime = newest) AS last_job_uid
  FROM (SELECT *, max(createtime) OVER (PARTITION BY timetable_uid) AS newest FROM stats)
  GROUP BY timetable_uid)"""


def fires(uid: str, ts: str) -> str:
    """Does the timetable's rule name the minute? By uid, as the rules are given out."""
    return f"""(CASE
      WHEN {uid} % 500 = 8 THEN true
      WHEN {uid} % 8 = 0 THEN minute({ts}) = {uid} % 60 AND hour({ts}) = {uid} % 24
      WHEN {uid} % 8 = 1 THEN minute({ts}) % 15 = 0 AND hour({ts}) BETWEEN 8 AND 17 AND isodow({ts}) <= 5
      WHEN {uid} % 8 = 2 THEN minute({ts}) = 0 AND hour({ts}) IN (0, 12) AND day({ts}) = 1 AND month({ts}) % 2 = 0
      WHEN {uid} % 8 = 3 THEN minute({ts}) = 0 AND hour({ts}) = 9 AND year({ts}) = 2024
      WHEN {uid} % 8 = 4 THEN minute({ts}) = 0 AND hour({ts}) = 12 AND isodow({ts}) <= 5
      WHEN {uid} % 8 = 5 THEN minute({ts}) = 45 AND hour({ts}) = 17 AND day({ts}) = 7 AND month({ts}) = 6
                          AND year({ts}) IN (2015, 2016)
      WHEN {uid} % 8 = 6 THEN minute({ts}) = 30 AND hour({ts}) IN (0, 6, 12, 18) AND day({ts}) IN (1, 15, 31)
                          AND month({ts}) = 1
      ELSE minute({ts}) IN (5, 35) AND hour({ts}) <= 5 AND isodow({ts}) >= 6 END)"""


def cron_values(uid: str) -> str:
    """Values of the rule's fields as JSON members, by uid; a field of one value is a number."""
    any_day = '"day":null,"month":null,"weekday":null,"year":null'
    return f"""(CASE
      WHEN {uid} % 500 = 8 THEN '"minute":null,"hour":null,{any_day}'
      WHEN {uid} % 8 = 0 THEN '"minute":' || ({uid} % 60) || ',"hour":' || ({uid} % 24) || ',{any_day}'
      WHEN {uid} % 8 = 1 THEN '"minute":[0,15,30,45],"hour":[8,9,10,11,12,13,14,15,16,17],"day":null,'
        || '"month":null,"weekday":[1,2,3,4,5],"year":null'
      WHEN {uid} % 8 = 2 THEN '"minute":0,"hour":[0,12],"day":1,"month":[2,4,6,8,10,12],"weekday":null,"year":null'
      WHEN {uid} % 8 = 3 THEN '"minute":0,"hour":9,"day":null,"month":null,"weekday":null,"year":2024'
      WHEN {uid} % 8 = 4 THEN '"minute":0,"hour":12,"day":null,"month":null,"weekday":[1,2,3,4,5],"year":null'
      WHEN {uid} % 8 = 5 THEN '"minute":45,"hour":17,"day":7,"month":6,"weekday":null,"year":[2015,2016]'
      WHEN {uid} % 8 = 6 THEN '"minute":30,"hour":[0,6,12,18],"day":[1,15,31],"month":1,"weekday":null,"year":null'
      ELSE '"minute":[5,35],"hour":[0,1,2,3,4,5],"day":null,"month":null,"weekday":[6,7],"year":null' END)"""


# A job's document from its columns.
JOB_DOCUMENT = f"""'{{"uid":' || uid || ',"name":"' || name || '","status":"' || status
          || '","createtime":' || createtime || ',"submittime":' || submittime
          || ',"starttime":' || coalesce(CAST(starttime AS VARCHAR), 'null')
          || ',"finishtime":' || coalesce(CAST(finishtime AS VARCHAR), 'null')
          || ',"priority":' || priority || ',"sparkappid":' || coalesce('"' || sparkappid || '"', 'null')
          || ',"entrypoint":"' || entrypoint || '","jar":"' || jar
          || '","options":{{"spark.driver.memory":"' || (uid % 7 + 1) || 'g","spark.executor.memory":"4g"}}'
          || ',"jobconf":["--key","' || uid || '"],"can_close":'
          || CASE WHEN status IN ('READY', 'DELAYED') THEN 'true' ELSE 'false' END || '}}'"""


def grid(start: str, end: str) -> str:
    return (
        f"grid AS (SELECT unnest(generate_series(TIMESTAMP '{start}', "
        f"TIMESTAMP '{end}' - INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS m)"
    )


OFFICE = "minute(ts) % 15 = 0 AND hour(ts) BETWEEN 8 AND 17 AND isodow(ts) <= 5"

# uid % 26: error, then values of minute, hour, day, month, weekday, year ('' with
# an error for a bad field, NULL for any), then the hour and year bit masks.
_H = "0,1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16,17,18,19,20,21,22,23"
_YEARS = "2014,2015,2016,2017,2018,2019,2020,2021,2022,2023,2024,2025,2026,2027,2028,2029,2030,2031"
_TEN = "0,1,2,3,4,5,6,7,8,9,10"
PARSED = [
    (None, None, None, None, None, None, None, -1, -1),
    (None, "0", "9", "1", None, "1", "2015", 512, 2),
    (None, "59", "23", "31", "12", "5", None, 8388608, -1),
    (None, "59", "23", "31", "12", "5", None, 8388608, -1),
    (None, "0", "0,12", "1", "2,4,6,8,10,12", None, None, 4097, -1),
    (None, "0,15,30,45", "0,6,12,18", "1,15,31", None, "1,2,3,4,5", None, 266305, -1),
    (None, "0,15,30,45", "0,6,12,18", "1,15,31", None, "1,2,3,4,5", None, 266305, -1),
    (None, "0", "12", None, None, "1,2,3,4,5", None, 4096, -1),
    (None, "5", "7", None, None, "1,3,7", _YEARS, 128, 262143),
    (None, "7", "0,5,10,15,20", "1,31", "1,2", None, "2031", 1082401, 131072),
    (None, "0", None, None, None, None, None, -1, -1),
    ("fields: 4", "", "", "", "", "", "", 0, 0),
    ("bad hour", None, "", None, None, None, None, 0, -1),
    ("bad day", None, None, "", None, None, "2015", -1, 2),
    ("bad month", None, None, "1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16,17,18,19,20,21,22,23,24,25,"
                            "26,27,28,29,30,31", "", None, "2015", -1, 2),
    ("bad minute", "", "", "11", "9", None, "2015", 0, 2),
    ("fields: 1", "", "", "", "", "", "", 0, 0),
    ("bad minute", "", None, None, None, None, None, -1, -1),
    ("bad minute", "", None, None, None, None, None, -1, -1),
    ("bad minute", "", None, None, None, None, None, -1, -1),
    ("bad day", None, None, "", None, None, None, -1, -1),
    ("bad hour", None, "", None, None, None, None, 0, -1),
    ("bad month", None, None, None, "", None, None, -1, -1),
    ("bad weekday", None, None, None, None, "", None, -1, -1),
    ("bad year", None, None, None, None, None, "", -1, 0),
    ("bad minute", "", None, None, None, None, None, -1, -1),
]


def literal(value) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, int) else "'" + value + "'"


def parsed_rows() -> str:
    return ",\n".join(f"({n}, {', '.join(map(literal, row))})" for n, row in enumerate(PARSED))


def hex_page(first: str, chunk: int, window: int) -> str:
    """The page's bytes in hex from column h (text in hex) and n (its bytes)."""
    body = f"substr(h, 2 * greatest({first}, 0) + 1, 2 * ({first} + {chunk} - greatest({first}, 0)))"
    if window == 0:
        return body
    before = (
        f"CASE WHEN {first} <= 0 THEN '' ELSE regexp_replace("
        f"substr(h, 2 * greatest({first} - {window}, 0) + 1, 2 * ({first} - greatest({first} - {window}, 0))), "
        f"'^(?:[1-9A-F][0-9A-F]|0[0-9B-F])*0A', '') END"
    )
    after = (
        f"regexp_extract(substr(h, 2 * ({first} + {chunk}) + 1, {2 * window}), "
        f"'^(?:[1-9A-F][0-9A-F]|0[0-9B-F])*')"
    )
    return f"CASE WHEN n = 0 THEN '' ELSE {before} || {body} || {after} END"


def pages(chunk: int, window: int, origin: str = "start") -> str:
    first = f"({chunk} * (page - 1))" if origin == "start" else f"(n - {chunk} * page)"
    return f"""
    raw AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents),
    counted AS (SELECT *, greatest((n + {chunk - 1}) // {chunk}, 1) AS page_count FROM raw),
    numbered AS (SELECT *, unnest(generate_series(1, page_count)) AS page FROM counted),
    paged AS (SELECT doc_id, CAST(page_count AS BIGINT) AS page_count, CAST(page AS BIGINT) AS page,
                     {hex_page(first, chunk, window)} AS block FROM numbered),
    nav AS (SELECT *, CASE WHEN page > 1 THEN page - 1 END AS prev_page,
                   CASE WHEN page < page_count THEN page + 1 END AS next_page,
                   CASE WHEN page_count > 1 THEN page_count END AS last_page FROM paged)"""


SNAPSHOTS = """
polls AS (
  SELECT event_id, user_id, event_type = 'purchase' AS done,
         CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 10 AS kind FROM events),
apps AS (
  SELECT event_id AS snapshot_id, 'app-' || event_id || '-0' AS app_id, 'u' || user_id AS app_name,
         CASE WHEN kind = 4 THEN true ELSE done END AS completed FROM polls WHERE kind >= 3
  UNION ALL
  SELECT event_id, 'app-' || event_id || '-1', 'u' || user_id, true FROM polls WHERE kind >= 5),
status AS (
  SELECT event_id AS snapshot_id,
         CAST(CASE WHEN kind IN (0, 2) THEN -2 WHEN kind IN (1, 4) OR done THEN 0 ELSE -1 END AS INTEGER)
           AS cluster_status FROM polls)"""

SUBMISSIONS = """
submissions AS (
  SELECT p_partkey AS uid, p_name AS name,
         CAST(p_size AS VARCHAR) || ['g', 'mb', 'M', 'b', 'gigabytes'][p_partkey % 5 + 1] AS memory,
         'com.test.P' || p_partkey || CASE WHEN p_partkey % 7 = 0 THEN '-x' ELSE '' END AS entrypoint,
         '/tmp/' || p_partkey || ['.jar', '.JAR', '.txt'][p_partkey % 3 + 1] AS jar,
         'a=' || p_size || ' name="' || p_name || '" --flag a=2'
           || CASE WHEN p_partkey % 11 = 5 THEN ' ''open' ELSE '' END AS options,
         'x\\ y ''it is'' ' || p_size AS jobconf, p_size,
         CAST((p_partkey % 4 - 1) * 60 AS VARCHAR) AS delay
  FROM part),
checked AS (
  SELECT uid, concat_ws(',',
    CASE WHEN uid % 5 >= 3 THEN 'dmemory,ememory' END, CASE WHEN uid < 3 THEN 'priority' END,
    CASE WHEN uid % 7 = 0 THEN 'entrypoint' END, CASE WHEN uid % 3 = 2 THEN 'jar' END,
    CASE WHEN uid % 11 = 5 THEN 'options' END) AS violations
  FROM submissions)"""

INVENTORY = """
inventory AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '[?#].*$', ''),
                                 '/$', '') AS path FROM pages),
split AS (SELECT page_id, path, string_split(path[2:], '/') AS parts FROM inventory)"""


def walk(machine: str) -> str:
    """Step-by-step replay; ``machine`` defines the CTEs moves and steps."""
    return f"""
WITH RECURSIVE {machine},
ranked AS (
  SELECT key, ts, action, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS n
  FROM acts WHERE action IS NOT NULL),
walk AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT) AS n, start AS status, CAST(NULL AS BIGINT) AS at_a,
         CAST(NULL AS BIGINT) AS at_b, CAST(0 AS BIGINT) AS accepted, CAST(0 AS BIGINT) AS rejected
  FROM ranked, begin
  UNION ALL
  SELECT w.key, w.n + 1, coalesce(m.target, w.status),
         CASE WHEN m.stamp = 'a' THEN r.ts ELSE w.at_a END,
         CASE WHEN m.stamp = 'b' THEN r.ts ELSE w.at_b END,
         w.accepted + CASE WHEN m.target IS NULL THEN 0 ELSE 1 END,
         w.rejected + CASE WHEN m.target IS NULL THEN 1 ELSE 0 END
  FROM walk w JOIN ranked r ON r.key = w.key AND r.n = w.n + 1
  LEFT JOIN moves m ON m.state = w.status AND m.action = r.action),
final AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1)"""


JOB_WALK = walk("""
begin AS (SELECT 'READY' AS start),
moves AS (SELECT * FROM (VALUES ('READY', 'run', 'RUNNING', 'a'), ('RUNNING', 'finish', 'FINISHED', 'b'),
  ('READY', 'close', 'CLOSED', '')) AS m(state, action, target, stamp)),
acts AS (
  SELECT user_id * 100 + day(ts) AS key, epoch_us(ts) AS ts, event_id AS seq,
         CASE event_type WHEN 'view' THEN 'run' WHEN 'click' THEN 'run' WHEN 'purchase' THEN 'finish'
                         WHEN 'error' THEN 'close' END AS action FROM events)""") + """
SELECT key, status, at_a AS starttime, at_b AS finishtime, accepted, rejected FROM final"""

TIMETABLE_WALK = walk("""
begin AS (SELECT 'ACTIVE' AS start),
moves AS (SELECT * FROM (VALUES ('ACTIVE', 'pause', 'PAUSED', ''), ('PAUSED', 'resume', 'ACTIVE', ''),
  ('ACTIVE', 'cancel', 'CANCELLED', 'a'), ('PAUSED', 'cancel', 'CANCELLED', 'a'))
  AS m(state, action, target, stamp)),
acts AS (
  SELECT user_id AS key, epoch_us(ts) AS ts, event_id AS seq,
         CASE WHEN event_type IN ('click', 'purchase') THEN 'pause'
              WHEN event_type IN ('view', 'signup') THEN 'resume'
              WHEN event_type = 'error' AND value > 150 THEN 'cancel' END AS action FROM events)""") + """
SELECT key, status, at_a AS canceltime, accepted, rejected FROM final"""


def words(items: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in items) + "]"


RUNS = f"""
WITH {JOBS}, {TIMETABLES}, {grid('2024-01-05 06:30:00', '2024-01-06 06:30:00')},
runs AS (
  SELECT t.uid AS timetable_uid, t.name || '-T-' || epoch_ms(m) AS name, 'READY' AS status,
         epoch_ms(m) AS createtime, j.*
  FROM due t JOIN grid ON {fires('t.uid', 'm')} JOIN jobs j ON j.uid = t.job_uid)"""

RUNNABLE = f"(status = 'READY' OR (status = 'DELAYED' AND submittime <= {NOW_MS}))"

_SLOTS = ", ".join(f"({p}, {n})" for p, n in POOL_SLOTS.items())

TOTALS = "SELECT timetable_uid, jobs, last_time, last_job_uid FROM totals"
STATUS = f"WITH {SNAPSHOTS} SELECT snapshot_id, cluster_status FROM status"
OFFICE_EVENTS = f"SELECT event_id, ts FROM events WHERE {OFFICE}"

ORACLE: dict[str, str] = {
    "a1_parse_schedules": f"""
        SELECT c_custkey AS uid, error IS NULL AS valid, error, minute_values, hour_values,
               day_values, month_values, weekday_values, year_values,
               CAST(hour_mask AS BIGINT) AS hour_mask, CAST(year_mask AS BIGINT) AS year_mask
        FROM customer JOIN (VALUES {parsed_rows()}) AS p(n, error, minute_values, hour_values, day_values,
          month_values, weekday_values, year_values, hour_mask, year_mask) ON n = c_custkey % 26""",
    "a2_cron_filter": OFFICE_EVENTS,
    "a2_cron_counts": f"SELECT event_type, count(*) AS events FROM events WHERE {OFFICE} GROUP BY 1",
    "a2_cron_years": """
        SELECT event_type, count(*) AS events FROM events
        WHERE hour(ts) IN (0, 12) AND day(ts) % 5 = 0 AND month(ts) IN (1, 3) AND isodow(ts) IN (6, 7)
          AND year(ts) = 2024 GROUP BY 1""",
    "a3_match_rules": f"""
        WITH {TIMETABLES}, rules AS (SELECT cron, min(uid) AS uid FROM due GROUP BY cron)
        SELECT cron, event_type, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS event_ids
        FROM rules JOIN events ON {fires('uid', 'ts')} GROUP BY 1, 2""",
    "a3_match_schedules": f"""
        WITH {TIMETABLES} SELECT event_id, uid AS timetable_uid
        FROM due JOIN events ON {fires('uid', 'ts')}""",
    "a3_match_summary": f"""
        WITH {TIMETABLES} SELECT uid AS timetable_uid, count(ts) AS matches, min(ts) AS first_ts,
               max(ts) AS last_ts FROM due LEFT JOIN events ON {fires('uid', 'ts')} GROUP BY 1""",
    "a4_fire_times": f"""
        WITH {TIMETABLES}, {grid('2024-01-01 00:00:00', '2024-02-01 00:00:00')}
        SELECT uid AS timetable_uid, m AS fire_ts FROM due JOIN grid ON {fires('uid', 'm')}""",
    "a5_spawn_runs": f"""
        {RUNS} SELECT timetable_uid, name, status, createtime, createtime AS submittime,
               CAST(NULL AS BIGINT) AS starttime, CAST(NULL AS BIGINT) AS finishtime,
               createtime AS priority, CAST(NULL AS VARCHAR) AS sparkappid, uid AS template_job_uid,
               entrypoint, jar, options, jobconf FROM runs""",
    "a5_spawn_fires": f"""
        {RUNS} SELECT timetable_uid, name, createtime, uid AS template_job_uid, jar FROM runs""",
    "a5_run_log": f"{RUNS} SELECT timetable_uid, name AS job_name, createtime FROM runs",
    "b1_derive_submission": """
        WITH s AS (SELECT o_orderkey AS uid, epoch_ms(o_orderdate) AS createtime,
                          greatest(o_orderkey % 7 - 2, 0) AS delay FROM orders)
        SELECT uid, createtime, createtime + delay * 1000 AS submittime,
               CASE WHEN delay > 1 THEN 'DELAYED' ELSE 'READY' END AS status,
               CASE WHEN delay > 1 THEN (createtime + delay * 1000) // 1000
                    ELSE createtime + delay * 1000 END AS priority FROM s""",
    "b2_list_by_status": f"""
        WITH {JOBS} SELECT uid, status, createtime FROM jobs WHERE status = 'READY'
        ORDER BY createtime DESC, uid LIMIT 100""",
    "b2_list_all": f"WITH {JOBS} SELECT uid, status, createtime FROM jobs",
    "b2_list_timetables": f"WITH {TIMETABLES} SELECT uid, status, createtime FROM timetables WHERE status = 'PAUSED'",
    "b2_list_templates": "SELECT p_partkey AS uid, p_partkey + 1 AS createtime FROM part",
    "b3_lookup": f"""
        WITH {JOBS}, {TIMETABLES} SELECT uid, name, status FROM jobs
        WHERE uid IN (SELECT job_uid FROM timetables WHERE status <> 'CANCELLED')""",
    "b4_runnable": f"WITH {JOBS} SELECT uid, status, priority FROM jobs WHERE {RUNNABLE}",
    "b4_runnable_top": f"""
        WITH {JOBS} SELECT uid, status, priority FROM jobs WHERE {RUNNABLE}
        ORDER BY priority, uid LIMIT 100""",
    "b5_admit": f"""
        WITH {JOBS}, busy AS (SELECT pool, count(*) AS n FROM jobs WHERE status = 'RUNNING' GROUP BY pool),
        queued AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY priority, uid) AS r
                   FROM jobs WHERE {RUNNABLE})
        SELECT uid, pool, priority FROM queued LEFT JOIN busy USING (pool)
        WHERE r <= 700 - coalesce(n, 0)""",
    "b5_admit_nulls": f"""
        WITH {JOBS}, busy AS (SELECT pool, count(*) AS n FROM jobs WHERE status = 'RUNNING' GROUP BY pool),
        waiting AS (SELECT 'job-' || (uid % 1000) || '-' || uid AS uid, pool, CASE WHEN uid % 5 <> 2 THEN uid % 3 END AS priority
                    FROM jobs WHERE {RUNNABLE}),
        queued AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY priority NULLS FIRST, uid) AS r FROM waiting)
        SELECT uid, pool, priority FROM queued LEFT JOIN busy USING (pool)
        WHERE r <= 700 - coalesce(n, 0)""",
    "b5_admit_by_pool": f"""
        WITH {JOBS}, slots AS (SELECT * FROM (VALUES {_SLOTS}) AS s(pool, slots)),
        busy AS (SELECT pool, count(*) AS n, count(*) FILTER (starttime <= {NOW_MS}) AS tracked
                 FROM jobs WHERE status = 'RUNNING' GROUP BY pool),
        queued AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY priority, uid) AS r
                   FROM jobs WHERE {RUNNABLE})
        SELECT uid, pool, priority FROM queued JOIN slots USING (pool) LEFT JOIN busy USING (pool)
        WHERE pool <> 7 AND coalesce(tracked, 0) < slots AND r <= slots - coalesce(n, 0)""",
    "b5_admit_global": f"""
        WITH {JOBS}, queued AS (SELECT *, row_number() OVER (ORDER BY priority, uid) AS r FROM jobs WHERE {RUNNABLE})
        SELECT uid, pool, priority FROM queued
        WHERE r <= {GLOBAL_SLOTS} - (SELECT count(*) FROM jobs WHERE status = 'RUNNING')""",
    "b5_admit_by_table": f"""
        WITH {JOBS}, queued AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY priority, uid) AS r,
                                       count(*) OVER (PARTITION BY pool) AS n FROM jobs WHERE {RUNNABLE})
        SELECT uid, pool, priority FROM queued WHERE r <= n // 10""",
    "b6_replay_jobs": JOB_WALK,
    "b6_replay_timetables": TIMETABLE_WALK,
    "b7_close_stale": f"""
        WITH {JOBS} SELECT uid, CASE status WHEN 'RUNNING' THEN 'CLOSED' ELSE status END AS status FROM jobs""",
    "b8_run_stats": f"""
        WITH {TIMETABLES}, {STATS} SELECT uid, coalesce(jobs, 0) AS jobs, last_time, last_job_uid
        FROM timetables LEFT JOIN totals ON timetable_uid = uid""",
    "b9_enrich_timetables": f"""
        WITH {JOBS}, {TIMETABLES} SELECT t.uid, cron, j.uid AS job_uid, j.name AS job_name,
               j.status AS job_status, finishtime AS job_finishtime
        FROM timetables t LEFT JOIN jobs j ON j.uid = t.job_uid""",
    "b10_list_enabled": f"""
        WITH {TIMETABLES} SELECT uid, status, cron FROM timetables WHERE status <> 'CANCELLED'""",
    "b11_running": f"WITH {JOBS} SELECT uid, starttime, sparkappid FROM jobs WHERE status = 'RUNNING'",
    "b12_elapsed": f"""
        WITH {JOBS}, t AS (SELECT *, finishtime - starttime AS ms, {NOW_MS} - createtime AS old FROM jobs)
        SELECT uid, ms AS elapsed_ms,
               CASE WHEN ms >= 3600000 THEN (ms // 3600000) || 'hrs ' || (ms // 60000 % 60) || 'min'
                    WHEN ms >= 60000 THEN (ms // 60000) || 'min ' || (ms // 1000 % 60) || 'sec'
                    WHEN ms IS NOT NULL THEN (ms // 1000) || 'sec (' || ms || ')' END AS elapsed_label,
               CASE WHEN old > 0 AND old < 60000 THEN 'less than a minute ago'
                    WHEN old >= 60000 AND old < 3600000 THEN (old // 60000) || ' minutes ago'
                    WHEN old >= 3600000 AND old < 86400000 THEN (old // 3600000) || ' hours ago'
                    ELSE strftime(make_timestamp(createtime * 1000), '%Y-%m-%d %H:%M:%S') END AS age
        FROM t""",
    "b13_expand_templates": f"""
        WITH {SUBMISSIONS}, ok AS (SELECT * FROM submissions WHERE uid % 13 <> 6)
        SELECT s.uid, s.uid + 1 AS createtime, ok.name AS job_name, ok.entrypoint AS job_entrypoint,
               ok.memory AS job_dmemory, ok.memory AS job_ememory, ok.options AS job_options,
               ok.jobconf AS job_jobconf, ok.delay AS job_delay, ok.jar AS job_jar
        FROM submissions s LEFT JOIN ok USING (uid)""",
    "b13_template_fields": """
        SELECT p_partkey AS uid, CASE WHEN p_partkey % 13 <> 6 THEN
          'deep={"list":[1,' || (p_partkey % 7) || ']};key=' || p_name || ';n=' || p_partkey END AS fields FROM part""",
    "b14_delete_by_key": f"""
        WITH {JOBS}, {TIMETABLES} SELECT uid, name FROM jobs
        WHERE uid NOT IN (SELECT job_uid FROM timetables)""",
    "b15_job_documents": f"WITH {JOBS} SELECT uid, status, {JOB_DOCUMENT} AS document FROM jobs",
    "b15_timetable_documents": f"""
        WITH {JOBS}, {TIMETABLES}, {STATS}, docs AS (SELECT uid, {JOB_DOCUMENT} AS document FROM jobs)
        SELECT t.uid, t.status, '{{"uid":' || t.uid || ',"name":"' || t.name || '","status":"' || t.status
          || '","canceltime":' || coalesce(CAST(canceltime AS VARCHAR), 'null')
          || ',"cron":{{"pattern":"' || cron || '",' || {cron_values('t.uid')} || '}},"job":'
          || coalesce(j.document, 'null')
          || ',"stats":{{"jobs":' || coalesce(jobs, 0)
          || ',"last_time":' || coalesce(CAST(last_time AS VARCHAR), 'null')
          || ',"last_job_uid":' || coalesce(CAST(last_job_uid AS VARCHAR), 'null')
          || '}},"can_pause":' || (t.status = 'ACTIVE') || ',"can_resume":' || (t.status = 'PAUSED')
          || ',"can_cancel":' || (t.status <> 'CANCELLED') || '}}' AS document
        FROM timetables t LEFT JOIN docs j ON j.uid = t.job_uid LEFT JOIN totals ON timetable_uid = t.uid""",
    "b15_template_documents": f"""
        WITH {SUBMISSIONS}, esc AS (
          SELECT uid, CASE WHEN uid % 9 = 0 THEN '  ' ELSE name END AS shown, name, memory, entrypoint, jar,
                 replace(options, '"', '\\"') AS options, replace(jobconf, '\\', '\\\\') AS jobconf, delay
          FROM submissions)
        SELECT uid, '{{"uid":' || uid || ',"name":"' || shown || '","createtime":' || (uid + 1) || ',"content":'
          || CASE WHEN uid % 13 = 6 THEN 'null' ELSE '{{"name":"' || name || '","entrypoint":"' || entrypoint
          || '","dmemory":"' || memory || '","ememory":"' || memory || '","options":"' || options
          || '","jobconf":"' || jobconf || '","delay":"' || delay || '","jar":"' || jar || '"}}' END
          || '}}' AS document
        FROM esc""",
    "b15_template_any_keys": """
        SELECT p_partkey AS uid, '{"uid":' || p_partkey || ',"name":"any","createtime":' || (p_partkey + 1) || ',"content":'
          || CASE WHEN p_partkey % 13 = 6 THEN 'null' ELSE '{"key":"' || p_name || '","n":' || p_partkey
          || ',"deep":{"list":[1,' || (p_partkey % 7) || ']}}' END || '}' AS document FROM part""",
    "c1_parse_apps": f"""
        WITH {SNAPSHOTS} SELECT event_id AS snapshot_id, app_id, app_name, completed,
               CASE WHEN kind = 2 THEN '{{"key":}}' END AS _corrupt
        FROM polls LEFT JOIN apps ON snapshot_id = event_id""",
    "c2_running_apps": f"""
        WITH {SNAPSHOTS} SELECT snapshot_id, app_id, app_name FROM apps WHERE NOT completed""",
    "c2_running_lists": f"""
        WITH {SNAPSHOTS} SELECT event_id AS snapshot_id,
               CASE WHEN kind IN (0, 2) THEN NULL WHEN kind = 1 OR kind = 4 OR done THEN ''
                    ELSE 'app-' || event_id || '-0' END AS apps FROM polls""",
    "c3_cluster_status": STATUS,
    "c4_html_elements": """
        WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS tag FROM pages)
        SELECT page_id, tag, count(*) AS elements FROM t
        WHERE tag NOT IN ('html', 'head', 'link', 'meta', 'br') GROUP BY 1, 2""",
    "c4_settings_elements": f"""
        WITH {JOBS}, laid AS (SELECT *, CASE WHEN uid % 7 = 3 THEN 8 ELSE 11 END AS k FROM jobs),
        cells AS (
          SELECT uid, 6 AS e, 5 AS p, 'spark.app.name' AS data FROM laid
          UNION ALL SELECT uid, 7, 5, name FROM laid
          UNION ALL SELECT uid, 9, 8, 'spark.app.id' FROM laid WHERE k = 11
          UNION ALL SELECT uid, 10, 8, 'app-' || uid FROM laid WHERE k = 11
          UNION ALL SELECT uid, k + CASE WHEN uid % 5 = 2 THEN 2 ELSE 1 END, k, 'spark.tickloom.jobId' FROM laid
          UNION ALL SELECT uid, k + CASE WHEN uid % 5 = 2 THEN 1 ELSE 2 END, k, CAST(uid AS VARCHAR) FROM laid)
        SELECT 'app-' || uid AS app_id, CAST(e AS INTEGER) AS elem_id, CAST(p AS INTEGER) AS parent_id,
               CAST(5 AS INTEGER) AS depth, data, true AS balanced FROM cells""",
    "c5_html_value_for": "SELECT 'app-' || o_orderkey AS app_id, CAST(o_orderkey AS VARCHAR) AS value FROM orders",
    "c5_value_of_elements": "SELECT 'app-' || o_orderkey AS app_id, CAST(o_orderkey AS VARCHAR) AS value FROM orders",
    "c6_link_apps_to_jobs": """
        SELECT 'app-' || o_orderkey AS app_id,
               CASE WHEN o_orderkey % 7 <> 3 THEN 'app-' || o_orderkey END AS sparkid,
               CAST(o_orderkey AS VARCHAR) AS jobid FROM orders WHERE o_orderstatus = 'P'""",
    "d1_page_count": """
        SELECT doc_id, CAST(greatest((octet_length(encode(text)) + 499) // 500, 1) AS BIGINT) AS page_count
        FROM documents""",
    "d2_read_range": """
        WITH raw AS (SELECT doc_id, hex(encode(text)) AS h FROM documents)
        SELECT doc_id, substr(h, 1001, 200) AS ahead, substr(h, 801, 200) AS back, substr(h, 1, 60) AS low,
               '' AS "out" FROM raw""",
    "d3_pages_from_start": f"WITH {pages(500, 100)} SELECT doc_id, page, page_count, block FROM paged",
    "d4_pages_from_end": f"WITH {pages(500, 100, 'end')} SELECT doc_id, page, page_count, block FROM paged",
    "d4_last_pages": f"""
        WITH {pages(500, 100, 'end')} SELECT doc_id, max(block) FILTER (page = 1) AS last,
               max(block) FILTER (page = 3) AS third FROM paged GROUP BY doc_id""",
    "d5_page_nav": f"WITH {pages(2000, 0)} SELECT * EXCLUDE (block) FROM nav",
    "d6_replace_in_lines": "SELECT doc_id, replace(text, 'the', '[.*]') AS text FROM documents",
    "e1_list_children": f"""
        WITH {INVENTORY}, levels AS (SELECT path, parts, unnest(generate_series(1, len(parts))) AS i FROM split),
        kids AS (SELECT '/' || array_to_string(parts[1:i - 1], '/') AS parent, parts[i] AS name,
                        bool_or(i < len(parts)) AS isdir FROM levels GROUP BY 1, 2)
        SELECT parent, name, isdir, CASE WHEN isdir THEN 'dir' ELSE '.html' END AS type,
               CASE WHEN parent = '/' THEN '/' ELSE parent || '/' END || name AS path
        FROM kids WHERE isdir OR name LIKE '%_.html'""",
    "e1_rejected_paths": f"""
        WITH {INVENTORY} SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'relative' WHEN 2 THEN 'empty part' ELSE 'no path' END AS reason
        FROM inventory WHERE page_id % 5 IN (1, 2, 4)""",
    "e1_list_directories": f"""
        WITH {INVENTORY}, levels AS (
          SELECT page_id, parts, unnest(generate_series(1, len(parts))) AS i FROM split WHERE page_id % 5 IN (0, 3))
        SELECT '/' || array_to_string(parts[1:i], '/') AS path, bool_or(i < len(parts) OR page_id % 5 = 3) AS isdir FROM levels GROUP BY 1""",
    "e2_breadcrumbs": f"""
        WITH {INVENTORY} SELECT page_id, array_to_string(list_concat(['home:/'],
          list_transform(generate_series(1, len(parts)),
            lambda i: parts[i] || ':/' || array_to_string(parts[1:i], '/'))), ' > ') AS crumbs FROM split""",
    "e3_within": f"""
        WITH {INVENTORY} SELECT page_id,
          path = '/spam-farm.example.org/en' OR path LIKE '/spam-farm.example.org/en/%' AS inside,
          path = '/spam-farm.example.org/e' OR path LIKE '/spam-farm.example.org/e/%' AS prefix_only
        FROM inventory""",
    "f1_json_or_else": """
        SELECT event_id, CASE WHEN event_id % 4 IN (1, 2) THEN -1
          ELSE CAST(regexp_extract(props, '[0-9]+') AS BIGINT) END AS k FROM events""",
    "f1_json_tails": """
        SELECT p_partkey, p_partkey % 9 >= 6 AS whole, CASE WHEN p_partkey % 9 >= 6 THEN p_partkey ELSE -1 END AS k,
               CASE WHEN p_partkey % 9 >= 6 THEN p_name ELSE 'none' END AS s FROM part""",
    "f2_int_or_else": """
        SELECT event_id, CASE WHEN event_id % 8 <= 2 THEN event_id WHEN event_id % 8 = 3 THEN -event_id
          ELSE -7 END AS number FROM events""",
    "f3_bool_or_else": """
        SELECT event_id, event_id % 13 NOT IN (4, 5, 6, 7, 12) AS flag FROM events""",
    "f4_parse_args": f"""
        WITH {SUBMISSIONS} SELECT uid,
          CASE WHEN uid % 11 <> 5 THEN 'a=' || p_size || '|name=' || name || '|--flag|a=2' END AS args,
          'x y|it is|' || p_size AS jobconf,
          CASE WHEN uid % 11 <> 5 THEN 'a=2;name=' || name END AS options FROM submissions""",
    "f5_job_options": f"""
        WITH {SUBMISSIONS} SELECT uid, CASE WHEN uid % 11 <> 5 THEN 'a=2;name=' || name
          || ';spark.driver.memory=' || lower(memory) || ';spark.executor.memory=' || lower(memory) END AS options
        FROM submissions""",
    "f6_timetable_rules": f"""
        WITH {TIMETABLES} SELECT uid, concat_ws(',', CASE WHEN uid % 4 - 1 <= 0 THEN 'createtime' END,
               CASE WHEN uid % 6 = 1 THEN 'status' END) AS violations FROM timetables""",
    "f6_validate": f"WITH {SUBMISSIONS} SELECT uid, violations FROM checked",
    "f6_violation_counts": f"""
        WITH {SUBMISSIONS}, r AS (SELECT unnest(string_split(violations, ',')) AS rule FROM checked
                                  WHERE violations <> '')
        SELECT rule, count(*) AS rows FROM r GROUP BY rule""",
    "f6_address_rules": """
        SELECT s_suppkey AS uid, concat_ws(',', CASE WHEN s_suppkey % 5 <> 0 THEN 'master_url' END,
               CASE WHEN s_suppkey % 5 NOT IN (1, 2) THEN 'ui_url' END, CASE WHEN s_suppkey % 5 <> 3 THEN 'jdbc_url' END) AS violations
        FROM supplier""",
    "f7_parse_uri": """
        SELECT s_suppkey AS uid,
          CASE WHEN s_suppkey % 5 < 3 THEN 'node-' || s_suppkey || '.example.org'
               WHEN s_suppkey % 5 = 3 THEN 'db' || s_suppkey || '.example.org' END AS host,
          CASE s_suppkey % 5 WHEN 0 THEN 7077 WHEN 1 THEN 8000 + s_suppkey % 1000 WHEN 2 THEN 8443
               WHEN 3 THEN 3306 END AS port,
          CASE WHEN s_suppkey % 5 = 3 THEN 'main' END AS database,
          CASE WHEN s_suppkey % 5 = 3 THEN 'u' END AS "user",
          s_suppkey % 5 = 0 AS is_master, s_suppkey % 5 IN (1, 2) AS is_ui, s_suppkey % 5 = 3 AS is_jdbc
        FROM supplier""",
    "f8_canonical_name": f"""
        SELECT p_partkey AS uid, CASE WHEN p_partkey % 9 <> 0 THEN p_name ELSE
          {words(ADJECTIVES)}[p_partkey % 16 + 1] || '-' || {words(NOUNS)}[p_partkey // 16 % 16 + 1] || '-'
          || lpad(CAST(p_partkey // 256 % 10000 AS VARCHAR), 4, '0') END AS name FROM part""",
    "f9_times": """
        SELECT event_id, epoch_ms(date_trunc('second', ts)) AS ms,
               CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts FROM events""",
    "s1_read_tables": f"""
        WITH {JOBS}, {TIMETABLES}, {STATS}
        SELECT 'job' AS "table", count(*) AS rows, CAST(sum(createtime) AS BIGINT) AS createtimes FROM jobs
        UNION ALL SELECT 'timetable', count(*), CAST(sum(createtime) AS BIGINT) FROM timetables
        UNION ALL SELECT 'timetable_stats', count(*), CAST(sum(createtime) AS BIGINT) FROM stats
        UNION ALL SELECT 'template', count(*), CAST(sum(p_partkey + 1) AS BIGINT) FROM part""",
    "s1_read_jobs": f"WITH {JOBS} SELECT * EXCLUDE (pool) FROM jobs",
    "s1_read_timetables": f"WITH {TIMETABLES} SELECT * FROM timetables",
    "s1_read_timetable_stats": f"WITH {STATS} SELECT * FROM stats",
    "s1_read_templates": f"""
        WITH {SUBMISSIONS} SELECT uid, CASE WHEN uid % 9 = 0 THEN '  ' ELSE name END AS name, uid + 1 AS createtime,
               CASE WHEN uid % 13 = 6 THEN '{{broken' ELSE '{{"name":"' || name || '","entrypoint":"' || entrypoint
               || '","dmemory":"' || memory || '","ememory":"' || memory
               || '","options":"' || replace(options, '"', '\\"') || '","jobconf":"' || replace(jobconf, '\\', '\\\\')
               || '","delay":"' || delay || '","jar":"' || jar || '"}}' END AS content
        FROM submissions""",
    "s2_write_metadata": f"WITH {JOBS} SELECT * EXCLUDE (pool) FROM jobs",
    "s3_read_logs": """
        SELECT doc_id AS uid, 'stdout' AS type, CAST(octet_length(encode(text)) AS BIGINT) AS length,
               md5(text) AS digest FROM documents""",
    "s3_read_log_pages": f"""
        WITH {pages(4096, 128)} SELECT doc_id AS uid, 'stdout' AS type, * EXCLUDE (doc_id) FROM nav""",
    "s3_pages_from_end": f"""
        WITH {pages(4096, 128, 'end')} SELECT doc_id AS uid, 'stdout' AS type, page, page_count, block FROM paged""",
    "s3_read_one_page": f"""
        WITH {pages(4096, 128)} SELECT c.doc_id AS uid, 'stdout' AS type, c.doc_id % 3 + 1 AS page,
               CAST(c.page_count AS BIGINT) AS page_count, p.block
        FROM counted c LEFT JOIN paged p ON p.doc_id = c.doc_id AND p.page = c.doc_id % 3 + 1""",
    "s3_empty_logs": """
        SELECT doc_id AS uid, 'stdout' AS type, n AS length, greatest(1, (n + 4095) // 4096) AS pages,
               greatest(1, (n + 4095) // 4096) AS page_count
        FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE CAST(octet_length(encode(text)) AS BIGINT) END AS n FROM documents)""",
    "s4_cron_stream": OFFICE_EVENTS,
    "s5_spawn_stream": f"""
        WITH {JOBS}, {TIMETABLES}, minutes AS (SELECT DISTINCT date_trunc('minute', ts) AS m FROM events)
        SELECT t.uid AS timetable_uid, t.name || '-T-' || epoch_ms(m) AS name, 'READY' AS status,
               epoch_ms(m) AS createtime, epoch_ms(m) AS priority, entrypoint,
               t.name || '-T-' || epoch_ms(m) AS job_name
        FROM due t JOIN minutes ON {fires('t.uid', 'm')} JOIN jobs j ON j.uid = t.job_uid""",
    "s6_job_status_stream": JOB_WALK,
    "s6_timetable_status_stream": TIMETABLE_WALK,
    "s7_run_stats_stream": f"WITH {STATS} {TOTALS}",
    "s8_cluster_status_stream": STATUS,
    "flow_admission_round": f"""
        WITH {JOBS}, {SUBMISSIONS},
        busy AS (SELECT pool, count(*) AS n FROM jobs WHERE status = 'RUNNING' GROUP BY pool),
        queued AS (SELECT uid, uid % 8 AS pool, row_number() OVER (PARTITION BY uid % 8 ORDER BY uid) AS r
                   FROM checked WHERE violations IN ('', 'priority') AND uid % 4 < 2)
        SELECT uid, pool, 'READY' AS status, CAST({NOW_MS} AS BIGINT) AS submittime,
               CAST({NOW_MS} AS BIGINT) AS priority
        FROM queued LEFT JOIN busy USING (pool) WHERE r <= 1500 - coalesce(n, 0)""",
    "flow_log_pages": f"""
        WITH {pages(65536, 128)} SELECT * REPLACE (md5(unhex(block)) AS block) FROM nav""",
}
