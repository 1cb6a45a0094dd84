from __future__ import annotations

import numpy as np
import pyarrow as pa

from tickloom.llm import cap_filters, queries


def brute(rows: list[tuple], cosine: float = 0.9):
    """(links per vector, component) of all usable vectors; the others are alone."""
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float64)
    ids = sorted(good)
    label, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = good[a], good[b]
            if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine:
                links[a] += 1
                links[b] += 1
                p, q = sorted((root(a), root(b)))
                label[q] = p
    return {i: (links.get(i, 0), root(i) if i in label else i) for i, _ in rows}


def compare(spark, rows, least=0.99, **how):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS label", "2 AS key", "3 AS rep")
    got = cap_filters.cap_filter_classes(frame.repartition(3), **how).collect()
    assert sorted(str(r["vec_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    found = sum(r["n_links"] for r in got)
    assert all(r["n_links"] <= want[r["vec_id"]][0] for r in got)
    assert found >= least * sum(want[r["vec_id"]][0] for r in got)
    assert all(r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"]) for r in got)
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}, want


def test_clusters(spark):
    draw = np.random.default_rng(2)
    rows, centres = [], draw.normal(size=(12, 64))
    for k in range(1500):
        v = draw.normal(size=64) if k % 3 else centres[k % 12] + draw.normal(size=64) * 0.2
        rows.append((k, (v * (1 + k % 5)).tolist()))
    rows += [(2000 + k, rows[7][1]) for k in range(40)]
    got, want = compare(spark, rows)
    assert {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in want.items()}


def test_blocks_of_a_full_filter(spark, monkeypatch):
    monkeypatch.setattr(cap_filters, "BLOCK_ROWS", 8)
    draw = np.random.default_rng(5)
    centre = draw.normal(size=32)
    rows = [(k, (centre + draw.normal(size=32) * 0.1).tolist()) for k in range(120)]
    got, want = compare(spark, rows, 1.0)
    assert got == want


def test_no_row_per_pair(spark, monkeypatch):
    """What leaves the tasks grows with the members of a group, not with its pairs; each pair counts once, with its copies."""
    monkeypatch.setattr(cap_filters, "BLOCK_ROWS", 64)
    draw = np.random.default_rng(7)
    centre = draw.normal(size=32)
    rows = [(k, (centre + draw.normal(size=32) * 0.05).tolist(), 1 + k % 3) for k in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, copies long")
    found = cap_filters.links_of(frame, 0.9).collect()
    assert len(found) < 30 * len(rows)  # of 44,850 pairs
    n = dict.fromkeys(range(300), 0)
    for a, b, many in found:
        n[a] += many or 0
        assert (b is None) != (many is None)
    assert n == {k: sum(r[2] for r in rows) - c for k, _, c in rows}


def test_filters_in_common():
    draw = np.random.default_rng(3)
    lists = [draw.choice(400, size=draw.integers(0, 30), replace=False).tolist() for _ in range(200)]
    a, b = np.triu_indices(200, 1)
    whole = pa.array([[1], *lists], pa.list_(pa.int64())).slice(1)
    assert cap_filters._in_common(whole, a, b).tolist() == [bool(set(lists[x]) & set(lists[y])) for x, y in zip(a, b)]


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [float("nan"), 1.0, 0.0]),
            (8, [None, 1.0, 0.0]), (9, [float("inf"), 0.0, 0.0]), (10, [1.0, 0.0]), (11, [3.0, 0.0]), (12, [-1.0, 0.0, 0.0]), (13, [5.0]), (14, [-5.0]),
            (15, [4.0]), (16, [1e-30, 0.0, 0.0]), (17, [1e30, 1e29, 0.0]), (None, [1.0, 0.0, 0.0])]
    got, want = compare(spark, rows, 1.0)
    assert {i: v for i, v in got.items() if i} == {i: v for i, v in want.items() if i}
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert cap_filters.cap_filter_classes(empty).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r)[:3] for r in cap_filters.cap_filter_classes(twice).collect()) == [(1, 1, 1), (1, 1, 1), (2, 1, 1)]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r[0], r[1]) for r in queries.table(spark, sf, "embeddings").select("vec_id", "embedding").collect()]
    want = brute(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in queries.op4_cap_filters(spark, sf).collect()}
    assert got == want
