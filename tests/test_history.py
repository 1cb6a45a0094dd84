"""Replay of status changes: golden cases, hot keys, slices and batches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import history as H


def brute(events, machine, start=None):
    """(status, stamps, accepted, rejected) of ordered (ts, seq, action) triples."""
    state, stamps, taken, refused = start or machine.initial, {}, 0, 0
    for ts, _, action in sorted(events):
        target = machine.moves.get((state, action))
        if target is None:
            refused += 1
            continue
        state, taken = target, taken + 1
        if action in machine.stamps:
            stamps[machine.stamps[action]] = ts
    return (state, *[stamps.get(c) for c in machine.stamps.values()], taken, refused)


def replayed(df, machine):
    names = ["status", *machine.stamps.values(), "accepted", "rejected"]
    return {r.key: tuple(r[n] for n in names) for r in df.collect()}


def random_events(rng, machine, sizes):
    actions = [*machine.actions, "unknown"]
    rows, seq = [], 0
    for key, size in sizes.items():
        for _ in range(size):
            rows.append((key, rng.randint(0, max(size // 2, 1)), seq, rng.choice(actions)))
            seq += 1
    rng.shuffle(rows)
    return rows


def by_key(rows):
    found = {}
    for key, ts, seq, action in rows:
        found.setdefault(key, []).append((ts, seq, action))
    return found


SCHEMA = "key string, ts bigint, seq bigint, action string"


def test_golden(spark):
    rows = [("a", 1, 1, "run"), ("a", 2, 2, "run"), ("a", 5, 3, "finish"), ("a", 6, 4, "close"),
            ("b", 1, 5, "finish"), ("b", 2, 6, "close"), ("b", 3, 7, "run"), ("c", 1, 8, None)]
    got = replayed(H.replay_transitions(spark.createDataFrame(rows, SCHEMA), H.JOB_MACHINE), H.JOB_MACHINE)
    assert got == {"a": ("FINISHED", 1, 5, 2, 2), "b": ("CLOSED", None, None, 1, 2)}
    rows = [("t", 1, 1, "pause"), ("t", 2, 2, "pause"), ("t", 3, 3, "resume"), ("t", 4, 4, "cancel"),
            ("t", 5, 5, "cancel"), ("t", 6, 6, "resume"), ("u", 1, 1, "resume")]
    got = replayed(
        H.replay_transitions(spark.createDataFrame(rows, SCHEMA), H.TIMETABLE_MACHINE), H.TIMETABLE_MACHINE)
    assert got == {"t": ("CANCELLED", 4, 3, 3), "u": ("ACTIVE", None, 0, 1)}


@pytest.mark.parametrize("machine", [H.JOB_MACHINE, H.TIMETABLE_MACHINE], ids=["job", "timetable"])
@pytest.mark.parametrize("batch", [10_000, 7, 1])
def test_hot_key_against_brute_force(spark, machine, batch):
    rng = random.Random(batch)
    sizes = {f"k{i}": rng.randint(1, 12) for i in range(150)} | {"hot": 700}
    # cancel is rare, or the hot key would end at once
    rows = [r for r in random_events(rng, machine, sizes) if r[3] != "cancel" or rng.random() < 0.01]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = replayed(
            H.replay_transitions(spark.createDataFrame(rows, SCHEMA).repartition(5), machine), machine)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {key: brute(events, machine) for key, events in by_key(rows).items()}


def test_hot_key_is_split_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [("hot", i, i, "pause" if i % 2 else "resume") for i in range(4000)]
        pieces = H.effects(spark.createDataFrame(rows, SCHEMA), H.TIMETABLE_MACHINE).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(pieces) > 1 and sum(p.events for p in pieces) == 4000
    assert max(p.events for p in pieces) < 2000


def test_composed_effects_settle_alike(spark):
    machine, rng = H.TIMETABLE_MACHINE, random.Random(4)
    rows = random_events(rng, machine, {f"k{i}": 9 for i in range(40)})
    pieces = None
    for n in range(3):  # three batches, in arrival order
        part = spark.createDataFrame([r for r in rows if r[2] % 3 == n], SCHEMA)
        effect = H.effects(part, machine).withColumn("batch", F.lit(n))
        pieces = effect if pieces is None else pieces.unionByName(effect)
    order = ("batch", "first_ts", "first_seq")
    want = {}
    for key, events in by_key(rows).items():
        state, stamp, taken, refused = machine.initial, None, 0, 0
        for n in range(3):
            end = brute([e for e in events if e[1] % 3 == n], machine, state)
            state, stamp = end[0], end[1] if end[1] is not None else stamp
            taken, refused = taken + end[2], refused + end[3]
        want[key] = (state, stamp, taken, refused)
    assert replayed(H.settle(pieces, machine, order), machine) == want
    assert replayed(H.settle(H.compose(pieces, machine, order), machine), machine) == want


def test_given_initial_states(spark):
    rows = [("a", 1, 1, "finish"), ("b", 1, 1, "run"), ("c", 1, 1, "run")]
    initial = spark.createDataFrame([("a", "RUNNING"), ("b", "CLOSED")], "key string, status string")
    got = replayed(
        H.replay_transitions(spark.createDataFrame(rows, SCHEMA), H.JOB_MACHINE, initial=initial), H.JOB_MACHINE)
    assert got == {"a": ("FINISHED", None, 1, 1, 0), "b": ("CLOSED", None, None, 0, 1),
                   "c": ("RUNNING", 1, None, 1, 0)}


def longest_list(spark, pieces, machine, fold):
    """The most effects that one group of the round's fold has."""
    return fold(pieces, machine).groupBy("key").count().agg(F.max("count")).first()[0]


def test_lists_stay_short_in_rounds(spark, monkeypatch):
    """A key with 3,000 slices is folded to at most ``FOLD`` effects, and comes out as by brute force."""
    machine, rng = H.TIMETABLE_MACHINE, random.Random(8)
    rows = [("hot", n, n, rng.choice(["pause", "resume", "resume", "unknown"])) for n in range(3000)] + [("cold", 1, 1, "pause"), ("cold", 2, 2, "cancel")]
    per_event = H.effects(spark.createDataFrame(rows, SCHEMA).withColumn("key", F.concat_ws("/", "key", "seq")), machine)
    # as if each event had been a slice of its own
    pieces = per_event.withColumn("slice", F.col("first_seq").cast("int")).withColumn("key", F.split("key", "/")[0]).checkpoint()
    want = {key: brute(events, machine) for key, events in by_key(rows).items()}
    assert longest_list(spark, pieces, machine, lambda p, m: H._by_slices(p, m, 3000)) <= H.FOLD
    assert longest_list(spark, pieces, machine, lambda p, m: H._by_counting(p, m, H.ORDER)) <= H.FOLD
    assert replayed(H.settle(H._by_slices(pieces, machine, 3000), machine), machine) == want
    assert replayed(H.settle(H.compose(pieces, machine), machine), machine) == want
    spark.conf.set("spark.sql.shuffle.partitions", "70")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(H, "FOLD", 4)
    try:
        got = H.replay_transitions(spark.createDataFrame(rows, SCHEMA).repartition(5), machine)
        assert replayed(got, machine) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
