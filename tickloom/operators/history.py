"""Guarded status changes replayed from event logs.

A machine has a handful of states, and what a run of events does to a key is a
small table: for each state it may start in, the state it ends in, how many events
were accepted and rejected, and which times were set. Such *effects* compose, so a
key's history can be cut anywhere. Events are range-partitioned on (key, ts, seq),
which splits a key of any size over many tasks; each task folds its slice to one
effect per key, and only effects are brought together per key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import scratch_dir


@dataclass(frozen=True)
class Machine:
    """Legal moves (state, action) -> state, and the time column an action sets."""

    initial: str
    moves: dict[tuple[str, str], str]
    stamps: dict[str, str] = field(default_factory=dict)

    @property
    def states(self) -> list[str]:
        return sorted({s for (s, _), _ in self.moves.items()} | set(self.moves.values()))

    @property
    def actions(self) -> list[str]:
        return sorted({a for _, a in self.moves})

    def table(self) -> np.ndarray:
        """Next state by (action, state); -1 is illegal. The last row is for unknown actions."""
        states, actions = self.states, self.actions
        nxt = np.full((len(actions) + 1, len(states)), -1, dtype=np.int32)
        for (state, action), target in self.moves.items():
            nxt[actions.index(action), states.index(state)] = states.index(target)
        return nxt


# The two machines.
JOB_MACHINE = Machine(
    initial="READY",
    moves={
        ("READY", "run"): "RUNNING",
        ("DELAYED", "run"): "RUNNING",
        ("RUNNING", "finish"): "FINISHED",
        ("READY", "close"): "CLOSED",
        ("DELAYED", "close"): "CLOSED",
    },
    stamps={"run": "starttime", "finish": "finishtime"},
)

TIMETABLE_MACHINE = Machine(
    initial="ACTIVE",
    moves={
        ("ACTIVE", "pause"): "PAUSED",
        ("PAUSED", "resume"): "ACTIVE",
        ("ACTIVE", "cancel"): "CANCELLED",
        ("PAUSED", "cancel"): "CANCELLED",
    },
    stamps={"cancel": "canceltime"},
)

UNSET = np.iinfo(np.int64).min


class Steps:
    """What runs of events can do to the state, numbered.

    An action is a function on states, and so is a run of actions. A small machine has
    few such functions, so each gets a number and a table tells what two in a row give.
    """

    def __init__(self, machine: Machine) -> None:
        nxt = machine.table()
        width = nxt.shape[1]
        moves = [tuple(np.where(row >= 0, row, np.arange(width)).tolist()) for row in nxt]
        found = [tuple(range(width))]  # number 0 changes nothing
        for step in found:  # grows while it is read
            for move in moves:
                longer = tuple(move[state] for state in step)
                if longer not in found:
                    found.append(longer)
        number = {step: i for i, step in enumerate(found)}
        self.ends = np.array(found)
        self.of_action = np.array([number[move] for move in moves])
        self.then = np.array(
            [[number[tuple(b[state] for state in a)] for b in found] for a in found]
        )
        # by action and by what came before: is it accepted, for each state at the start?
        self.accepted = (nxt >= 0)[:, self.ends]


def segment_effects(
    actions: np.ndarray, ts: np.ndarray, starts: np.ndarray, steps: Steps, stamped: list[int]
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Effects of consecutive segments of ordered events: ends, accepted, stamp times.

    Joining neighbours at distance 1, 2, 4, … gives every prefix of every segment in a
    logarithmic number of array steps.
    """
    n = len(actions)
    lengths = np.diff(np.append(starts, n))
    segment = np.repeat(np.arange(len(starts)), lengths)
    reach = np.arange(n) - starts[segment]  # earlier events in the same segment
    upto = steps.of_action[actions]
    step = 1
    while step < lengths.max():
        later = np.nonzero(reach >= step)[0]
        upto[later] = steps.then[upto[later - step], upto[later]]
        step *= 2
    before = np.zeros(n, dtype=upto.dtype)
    before[1:] = upto[:-1]
    before[starts] = 0
    accepted = steps.accepted[actions, before]
    times = []
    for action in stamped:
        at = np.full((len(starts), accepted.shape[1]), UNSET)
        rows = np.nonzero(actions == action)[0]
        for state in range(accepted.shape[1]):
            taken = rows[accepted[rows, state]]
            at[segment[taken], state] = ts[taken]  # in order, so the last one stays
        times.append(at)
    total = np.add.reduceat(accepted.astype(np.int64), starts, axis=0)
    return steps.ends[upto[starts + lengths - 1]], total, times


def _fold_batches(machine: Machine):
    """mapInArrow function: rows ordered by (key, ts, seq) to one effect per key."""
    steps = Steps(machine)
    stamped = [machine.actions.index(a) for a in machine.stamps]
    width = len(machine.states)

    def as_batch(keys, first_ts, first_seq, count, ends, accepted, times) -> pa.RecordBatch:
        offsets = pa.array(np.arange(len(count) + 1, dtype=np.int32) * width)

        def lists(values, kind, mask=None):
            flat = pa.array(np.ascontiguousarray(values).ravel(), type=kind,
                            mask=None if mask is None else mask.ravel())
            return pa.ListArray.from_arrays(offsets, flat)

        part = TaskContext.get().partitionId()
        arrays = [keys, pa.array(np.full(len(count), part, np.int32)), pa.array(first_ts, pa.int64()), pa.array(first_seq, pa.int64()),
                  pa.array(count, pa.int64()), lists(ends, pa.int32()), lists(accepted, pa.int64())]
        arrays += [lists(t, pa.int64(), t == UNSET) for t in times]
        names = ["key", "slice", "first_ts", "first_seq", "events", "ends", "accepted"]
        return pa.RecordBatch.from_arrays(arrays, names + [f"at_{i}" for i in range(len(times))])

    def joined(a, b):
        """Effect a, then effect b, of one key."""
        keys, ts, seq, count, ends, accepted, times = a
        _, _, _, more, ends_b, accepted_b, times_b = b
        via = ends[0]
        later = [np.where(tb[:, via] != UNSET, tb[:, via], t) for t, tb in zip(times, times_b)]
        return (keys, ts, seq, count + more, ends_b[:, via], accepted + accepted_b[:, via], later)

    def cut(effect, lo, hi):
        keys, ts, seq, count, ends, accepted, times = effect
        return (keys.slice(lo, hi - lo), ts[lo:hi], seq[lo:hi], count[lo:hi], ends[lo:hi],
                accepted[lo:hi], [t[lo:hi] for t in times])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_effect = None  # the last key may go on in the next batch
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            keys = batch.column(0)
            changed = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            starts = np.append(0, np.nonzero(changed)[0] + 1)
            ts, seq, actions = (batch.column(i).to_numpy() for i in (1, 2, 3))
            ends, accepted, times = segment_effects(actions, ts, starts, steps, stamped)
            count = np.diff(np.append(starts, n))
            effect = (keys.take(pa.array(starts)), ts[starts], seq[starts], count, ends, accepted, times)
            first = 0
            if open_effect is not None:
                if open_effect[0][0].equals(keys[0]):
                    open_effect = joined(open_effect, cut(effect, 0, 1))
                    first = 1
                if first < len(starts):
                    yield as_batch(*open_effect)
            if first < len(starts):
                if len(starts) - 1 > first:
                    yield as_batch(*cut(effect, first, len(starts) - 1))
                open_effect = cut(effect, len(starts) - 1, len(starts))
        if open_effect is not None:
            yield as_batch(*open_effect)

    return fold


def numbered(
    events: DataFrame,
    machine: Machine,
    key_col: str = "key",
    ts_col: str = "ts",
    seq_col: str = "seq",
    action_col: str = "action",
) -> DataFrame:
    """(key, ts, seq, action) with actions as numbers of the machine; its count of actions stands for all others.

    Rows without a key or an action are left out; a missing time or number is 0.
    """
    known = F.array_position(F.array(*map(F.lit, machine.actions)), F.col(action_col)).cast("int")
    action = F.when(known > 0, known - 1).otherwise(F.lit(len(machine.actions)))
    return events.filter(
        F.col(action_col).isNotNull() & F.col(key_col).isNotNull()
    ).select(
        F.col(key_col).alias("key"),
        F.coalesce(F.col(ts_col).cast("bigint"), F.lit(0)).alias("ts"),
        F.coalesce(F.col(seq_col).cast("bigint"), F.lit(0)).alias("seq"),
        action.alias("action"),
    )


def effects(
    events: DataFrame,
    machine: Machine,
    key_col: str = "key",
    ts_col: str = "ts",
    seq_col: str = "seq",
    action_col: str = "action",
) -> DataFrame:
    """Effects of ordered events: one row per key and slice of the range partitioning, whose number is ``slice``.

    ``ts_col`` and ``seq_col`` are bigints and order a key's events, equal ones in the order of the machine's actions. Rows without an
    action are left out; an action the machine does not know is always rejected.
    """
    rows = numbered(events, machine, key_col, ts_col, seq_col, action_col)
    kind = rows.schema["key"].dataType.simpleString()
    stamps = "".join(f", at_{i} array<bigint>" for i in range(len(machine.stamps)))
    schema = (
        f"key {kind}, slice int, first_ts bigint, first_seq bigint, events bigint, "
        f"ends array<int>, accepted array<bigint>{stamps}"
    )
    return (
        rows.repartitionByRange("key", "ts", "seq", "action")
        .sortWithinPartitions("key", "ts", "seq", "action")
        .mapInArrow(_fold_batches(machine), schema)
    )


# Effects of a key that one list holds at most; a key with more is folded in rounds.
FOLD = 32
# How the effects of one ``effects`` follow each other.
ORDER = ("first_ts", "first_seq")


def _folded(pieces: DataFrame, machine: Machine, order: tuple[str, ...], groups: list[str]) -> DataFrame:
    """One effect per key and ``groups`` out of at most a list of them, applied in the given order."""
    width = len(machine.states)
    stamps = [f"at_{i}" for i in range(len(machine.stamps))]
    fields = [*order, "events", "ends", "accepted", *stamps]
    listed = pieces.groupBy("key", *groups).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("pieces")
    )

    def each(kind: str, value) -> Column:
        return F.array(*[F.lit(value(i)).cast(kind) for i in range(width)])

    def follow(now: Column, piece: Column) -> Column:
        def via(values: str, merge) -> Column:
            return F.zip_with(
                now[values], now["ends"], lambda old, at: merge(old, F.get(piece[values], at))
            )

        return F.struct(
            (now["events"] + piece["events"]).alias("events"),
            F.transform(now["ends"], lambda at: F.get(piece["ends"], at)).alias("ends"),
            via("accepted", lambda old, new: old + new).alias("accepted"),
            *[via(s, lambda old, new: F.coalesce(new, old)).alias(s) for s in stamps],
        )

    begin = F.struct(
        F.lit(0).cast("bigint").alias("events"),
        each("int", lambda i: i).alias("ends"),
        each("bigint", lambda i: 0).alias("accepted"),
        *[each("bigint", lambda i: None).alias(s) for s in stamps],
    )
    first = [F.get(F.col("pieces"), F.lit(0))[c].alias(c) for c in order]
    return listed.select(
        "key", *groups, *first, F.aggregate("pieces", begin, follow).alias("whole")
    ).select("key", *groups, *order, "whole.*")


def _by_slices(pieces: DataFrame, machine: Machine, slices: int) -> DataFrame:
    """The effects of one :func:`effects` with neighbouring slices of a key folded, round by round, to at most ``FOLD`` a key.

    A key's slices have consecutive numbers in order, so dividing them by ``FOLD`` makes groups of neighbours. A key that
    spans all slices never has a longer list, and no effect is counted first: how many rounds there are follows from ``slices``.
    """
    while slices > FOLD:
        grouped = pieces.withColumn("group", F.floor(F.col("slice") / FOLD))
        folded = _folded(grouped.drop("slice"), machine, ORDER, ["group"])
        pieces = folded.withColumnRenamed("group", "slice")
        slices = -(-slices // FOLD)
    return pieces


def _by_counting(pieces: DataFrame, machine: Machine, order: tuple[str, ...]) -> DataFrame:
    """The same for effects of several batches: a key's effects are numbered in order, and every ``FOLD`` neighbours become one.

    Numbers come from the places of the ordered effects in their partition and from the partitions' counts, so a key that has most
    of all effects is neither a list nor a window in one task. Effects are counted when this is called, and where a key
    has many they are checkpointed once a round.
    """
    crowd = pieces.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    columns = pieces.columns
    context = pieces.sparkSession.sparkContext
    if crowd > FOLD and context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_dir(pieces.sparkSession))
    while crowd > FOLD:
        ordered = pieces.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
        # the counts and the rows must see the same partitions
        placed = ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")).checkpoint()
        starts = placed.groupBy("key", "part").agg(F.min("place").alias("from"), F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        starts = starts.withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
        number = F.col("before") + F.col("place") - F.col("from")
        grouped = placed.join(starts, ["key", "part"]).withColumn("group", F.floor(number / FOLD))
        pieces = _folded(grouped, machine, order, ["group"]).select(*[c for c in columns if c != "slice"])
        crowd = -(-crowd // FOLD)
    return pieces


def compose(pieces: DataFrame, machine: Machine, order: tuple[str, ...] = ORDER) -> DataFrame:
    """One effect per key out of many, applied in the given order; no list holds more than ``FOLD`` of them.

    Effects of several batches, told apart by a column of ``order``, may be any number a key.
    """
    return _folded(_by_counting(pieces, machine, order), machine, order, [])


def settle(
    pieces: DataFrame,
    machine: Machine,
    order: tuple[str, ...] = ORDER,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Final status per key from effects, applied in the given order.

    ``initial`` (key, status) gives keys that do not start in the machine's initial
    state. Effects of one :func:`effects` fold in rounds of at most ``FOLD`` a key; those of several batches are
    brought down to that by :func:`compose` first, where a key may have many.
    """
    if order == ORDER and "slice" in pieces.columns:
        pieces = _by_slices(pieces, machine, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    states = F.array(*map(F.lit, machine.states))
    stamps = [f"at_{i}" for i in range(len(machine.stamps))]
    fields = [*order, "events", "ends", "accepted", *stamps]
    grouped = pieces.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("pieces")
    )
    start = F.lit(machine.states.index(machine.initial))
    if initial is not None:
        given = initial.select("key", F.array_position(states, F.col("status")).alias("_start"))
        grouped = grouped.join(given, "key", "left")
        start = F.coalesce((F.col("_start") - 1).cast("int"), start)
    zero = F.lit(0).cast("bigint")
    unset = F.lit(None).cast("bigint")

    def apply(now: Column, piece: Column) -> Column:
        state = now["state"]
        taken = F.get(piece["accepted"], state)
        return F.struct(
            F.get(piece["ends"], state).alias("state"),
            (now["accepted"] + taken).alias("accepted"),
            (now["rejected"] + piece["events"] - taken).alias("rejected"),
            *[F.coalesce(F.get(piece[s], state), now[s]).alias(s) for s in stamps],
        )

    begin = F.struct(
        start.alias("state"), zero.alias("accepted"), zero.alias("rejected"),
        *[unset.alias(s) for s in stamps],
    )
    end = grouped.select("key", F.aggregate("pieces", begin, apply).alias("end"))
    return end.select(
        "key",
        F.get(states, F.col("end.state")).alias("status"),
        *[F.col(f"end.{s}").alias(name) for s, name in zip(stamps, machine.stamps.values())],
        "end.accepted",
        "end.rejected",
    )


def replay_transitions(
    events: DataFrame,
    machine: Machine,
    key_col: str = "key",
    ts_col: str = "ts",
    seq_col: str = "seq",
    action_col: str = "action",
    initial: DataFrame | None = None,
) -> DataFrame:
    """Final status, times set, accepted and rejected counts per key."""
    return settle(effects(events, machine, key_col, ts_col, seq_col, action_col), machine,
                  initial=initial)
