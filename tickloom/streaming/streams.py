"""Continuous forms of the operators. Their results are plain files or ledgers (``ledger``), which hold batches whole.

``cron_filter``, ``cluster_status`` and ``parse_apps`` work on a stream as they are:
they are stateless.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.operators.history import UNSET, Machine, Steps, numbered, segment_effects
from tickloom.operators.records import run_totals
from tickloom.operators.schedules import active, minutes_of_rules, parse_schedules, run_log, spawn_due, to_minute
from tickloom.streaming import ledger

Trigger = dict[str, object]
Table = DataFrame | Callable[[], DataFrame]  # a function reads the table anew per batch
ALL_THERE_IS: Trigger = {"availableNow": True}


# -- sinks ---------------------------------------------------------------------


def append_rows(
    rows: DataFrame, path: str, checkpoint: str, trigger: Trigger = ALL_THERE_IS
) -> StreamingQuery:
    """New rows as Parquet files, each once."""
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def _run(batch: DataFrame) -> None:
    """Computes a batch whose rows are written already: the stream's state needs all of it."""
    batch.write.format("noop").mode("overwrite").save()


def write_batches(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    key: str | None = None,
    mode: str = "append",
    trigger: Trigger = ALL_THERE_IS,
) -> StreamingQuery:
    """Each micro-batch as a batch of the ledger at ``path``; with a ``key``, its rows replace earlier ones of their key.

    A batch that is tried again counts once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if ledger.committed(path, batch_id):
            _run(batch)
        else:
            ledger.commit(batch, path, batch_id, key)

    return (
        rows.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


# -- runs spawned by ticks -----------------------------------------------------


def _once_per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each value of the only column once; the minutes of a year are half a million."""
    seen: set = set()
    for batch in batches:
        values = pc.unique(batch.column(0))
        new = [value.value not in seen for value in values]
        seen.update(value.value for value in values)
        yield pa.RecordBatch.from_arrays([values.filter(pa.array(new, pa.bool_()))], batch.schema.names)


def follow_due_runs(
    ticks: DataFrame,
    timetables: Table,
    jobs: Table,
    path: str,
    checkpoint: str,
    ts_col: str = "ts",
    trigger: Trigger = ALL_THERE_IS,
) -> StreamingQuery:
    """New jobs (ledger ``path/runs``) and run-log rows (``path/log``) for each minute that ticks.

    A minute counts once, however often and however late it ticks: the minutes seen are the stream's state, half a
    million a year, so a batch costs what its own minutes cost. PAUSED timetables stay in the table but give no run; where
    statuses change while the stream runs, pass a function that reads the table. A batch tried again counts once.

    Each task first thins its ticks out to single minutes, so a minute with most of the
    ticks is no bottleneck where its ticks meet. A batch's new minutes are written once (``path/minutes``) and read from there. Rules are parsed once and kept in ``path/rules``, a batch parses those it
    meets for the first time. It holds the minutes of each distinct rule, not of each timetable, finds the timetables
    that are due before it looks at jobs, and reads only the jobs those copy.
    """
    minutes = (
        ticks.select(to_minute(F.col(ts_col)).alias("minute"))
        .filter("minute IS NOT NULL")
        .mapInArrow(_once_per_task, "minute timestamp_ntz")
        .dropDuplicates(["minute"])
    )
    indexed = []  # whether a table that stays as it is has had its rules parsed

    def rules_of(listed: DataFrame, batch_id: int) -> DataFrame:
        """The parsed rules; those that no batch has met before are added."""
        spark, place = listed.sparkSession, f"{path}/rules"
        if not indexed or callable(timetables):
            texts = listed.select("cron").distinct()
            if ledger.newest(place) is not None:
                texts = texts.join(ledger.read(spark, place).select("cron"), "cron", "left_anti")
            ledger.commit(parse_schedules(texts, "cron"), place, batch_id)
            indexed.append(True)
        return ledger.read(spark, place).drop("batch")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if ledger.committed(f"{path}/log", batch_id):
            _run(batch)
            return
        if ledger.committed(f"{path}/runs", batch_id):
            _run(batch)
        else:
            # written, since whatever reads the batch itself runs the stream's state again
            if ledger.committed(f"{path}/minutes", batch_id):
                _run(batch)
            else:
                ledger.commit(batch, f"{path}/minutes", batch_id)
            fresh = ledger.read_batch(spark, f"{path}/minutes", batch_id)
            if fresh.isEmpty():
                return
            listed, templates = (t() if callable(t) else t for t in (timetables, jobs))
            due = minutes_of_rules(fresh, rules_of(active(listed), batch_id), "cron").select("cron", "minute").persist()
            try:
                due.count()  # Spark knows the size of what it has held
                ledger.commit(spawn_due(due, listed, templates), f"{path}/runs", batch_id)
            finally:
                due.unpersist()
        runs = ledger.read_batch(spark, f"{path}/runs", batch_id)
        ledger.commit(run_log(runs), f"{path}/log", batch_id)

    return (
        minutes.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


# -- status changes ------------------------------------------------------------


# Groups that share a row of state; a call of the state function takes a millisecond or two, however many keys it serves.
_GROUPS = 1 << 11


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _step(machine: Machine, key_type: pa.DataType):
    """The state function: a group's events of one batch, in order, on what is known of its keys.

    State is one small table per group of keys; those that have events are stepped together by array operations.
    """
    steps, states = Steps(machine), machine.states
    stamped = [machine.actions.index(a) for a in machine.stamps]
    counts = ["now", "accepted", "rejected", "late", "last_ts", "last_seq"]
    times = list(machine.stamps.values())

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(batches), ignore_index=True)
        found = pa.array(events["key"], key_type)
        keys = pc.unique(found)
        known = pa.ipc.open_stream(state.get[0]).read_all().combine_chunks() if state.exists else None
        place = pc.index_in(keys, known.column("key").combine_chunks()) if known is not None else pa.nulls(len(keys), pa.int32())
        is_old = place.is_valid().to_numpy(zero_copy_only=False)
        place = place.fill_null(-1).to_numpy()

        ts, seq, action, start = (events[c].to_numpy() for c in ("ts", "seq", "action", "start"))
        code = pc.index_in(found, keys).to_numpy()
        order = np.lexsort((action, seq, ts, code))
        ts, seq, action, code, start = ts[order], seq[order], action[order], code[order], start[order]
        firsts = np.searchsorted(code, np.arange(len(keys)))
        lasts = np.append(firsts[1:], len(code)) - 1

        def before(name: str, new: np.ndarray) -> np.ndarray:
            """What the state says of the batch's keys; ``new`` of those it does not know."""
            if known is None:
                return new.astype(np.int64)
            return np.where(is_old, known.column(name).to_numpy()[place], new)

        none = np.zeros(len(keys), np.int64)
        now, last_ts, last_seq = (before(n, v[firsts]) for n, v in (("now", start), ("last_ts", ts), ("last_seq", seq)))
        is_late = (ts < last_ts[code]) | (ts == last_ts[code]) & (seq < last_seq[code])
        late = before("late", none) + np.bincount(code[is_late & is_old[code]], minlength=len(keys))
        ends, total, set_at = segment_effects(action, ts, firsts, steps, stamped)
        rows = np.arange(len(keys))
        taken = total[rows, now]
        new_ts, new_seq = ts[lasts], seq[lasts]
        newer = (new_ts > last_ts) | (new_ts == last_ts) & (new_seq > last_seq)
        values = {
            "now": ends[rows, now], "accepted": before("accepted", none) + taken,
            "rejected": before("rejected", none) + (lasts - firsts + 1) - taken, "late": late,
            "last_ts": np.where(newer, new_ts, last_ts), "last_seq": np.where(newer, new_seq, last_seq),
        }
        for name, at in zip(times, set_at):
            values[name] = np.where(at[rows, now] == UNSET, before(name, none + UNSET), at[rows, now])

        mine = pa.table([keys, *[pa.array(values[c].astype(np.int64)) for c in (*counts, *times)]], names=["key", *counts, *times])
        table = mine
        if known is not None:
            others = np.ones(known.num_rows, bool)
            others[place[is_old]] = False
            table = pa.concat_tables([known.filter(pa.array(others)), mine])
        state.update((_packed(table.combine_chunks()),))
        out = {"key": keys.to_pandas(), "status": np.array(states, object)[values["now"]]}
        out |= {name: pd.array(values[name], dtype="Int64") for name in times}
        for name in times:
            out[name][values[name] == UNSET] = pd.NA
        yield pd.DataFrame(out | {name: values[name] for name in ("accepted", "rejected", "late")})

    return step


def follow_transitions(
    events: DataFrame,
    machine: Machine,
    path: str,
    checkpoint: str,
    trigger: Trigger = ALL_THERE_IS,
    initial: DataFrame | None = None,
    key_col: str = "key",
    ts_col: str = "ts",
    seq_col: str = "seq",
    action_col: str = "action",
) -> StreamingQuery:
    """Keeps the status of every key, in the stream's state and in the ledger at ``path``; read it with :func:`states_now`.

    Neither a batch nor a reader folds earlier events again: a key's state is one row of a small table, and a batch touches only
    the tables it has keys of. Keys are dealt to ``_GROUPS`` tables by their hash, since a call of the state function costs far
    more than a key's events; a group's number is part of the checkpoint. Within a batch events are ordered by (ts, seq), equal ones in the order of the machine's actions. An event that
    comes in a later batch than one of greater (ts, seq) is applied when it comes, as the queue's owner would, and counted
    in ``late``. ``initial`` (key, status) gives keys that do not start in the machine's initial state; it counts when a key is
    met first. Rows without a key or an action are left out.

    A group's events of one batch meet in one task, as some 30 bytes each; the source's limit on a batch bounds them.
    """
    rows = numbered(events, machine, key_col, ts_col, seq_col, action_col)
    states = F.array(*map(F.lit, machine.states))
    start = F.lit(machine.states.index(machine.initial))
    if initial is not None:
        given = initial.select("key", (F.array_position(states, F.col("status")) - 1).cast("int").alias("given"))
        rows = rows.join(given, "key", "left")
        start = F.when(F.col("given") >= 0, F.col("given")).otherwise(start)
    kind = rows.schema["key"].dataType
    stamps = "".join(f", {name} bigint" for name in machine.stamps.values())
    group = F.pmod(F.xxhash64("key"), F.lit(_GROUPS)).alias("group")
    current = rows.select("key", "ts", "seq", "action", start.alias("start"), group).groupBy("group").applyInPandasWithState(
        _step(machine, to_arrow_type(kind)),
        f"key {kind.simpleString()}, status string{stamps}, accepted bigint, rejected bigint, late bigint", "keys binary",
        "update", GroupStateTimeout.NoTimeout)
    return write_batches(current, path, checkpoint, "key", "update", trigger)


def states_now(spark: SparkSession, path: str) -> DataFrame:
    """(key, status, times set, accepted, rejected, late) per key after all batches written so far."""
    return ledger.read_latest(spark, path, "key")


# -- run statistics ------------------------------------------------------------


def follow_run_totals(
    stats: DataFrame, path: str, checkpoint: str, trigger: Trigger = ALL_THERE_IS
) -> StreamingQuery:
    """Run totals per timetable, kept current in the ledger at ``path``; read them with :func:`ledger.read_latest`.

    A batch writes the totals that changed in it, not all there are.
    """
    return write_batches(run_totals(stats), path, checkpoint, "timetable_uid", "update", trigger)
