from __future__ import annotations

import numpy as np
import pytest

from tickloom.llm import hard_negatives, queries


def brute(rows: list[tuple], anchor, count=5, share=(80, 100)) -> list[tuple]:
    """Every anchor against all rows, in whole numbers."""
    good = {}
    for i, label, v in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v):
            good[i] = min(good.get(i, (label, v)), (label, v))
    clip = lambda s: max(min(s, (1 << 63) - 1), -(1 << 63))
    dot = lambda a, b: clip(sum(int(x) * int(y) for x, y in zip(a, b)))
    out = []
    for i, (label, v) in good.items():
        if not anchor(i):
            continue
        met = [(-dot(v, w), j, other) for j, (other, w) in good.items() if j != i and len(v) == len(w)]
        for p, positive, _ in sorted(m for m in met if m[2] == label)[:count]:
            ps = -p
            fits = sorted(m for m in met if m[2] != label and share[0] * ps <= share[1] * -m[0] <= share[1] * ps)
            out += [(i, positive, k + 1, j, ps, -s) for k, (s, j, _) in enumerate(fits[:count])]
    return sorted(out)


def compare(spark, rows, every=10, **how):
    frame = spark.createDataFrame(rows, "vec_id long, label int, vector array<double>").selectExpr("*", "1 AS cell", "2 AS block", "3 AS score", "4 AS row")
    got = hard_negatives.mine_negatives(frame.repartition(3), f"vec_id % {every} = 0", **how)
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"),
                          ("positive_score", "bigint"), ("negative_score", "bigint")]
    got = sorted(tuple(r) for r in got.collect())
    assert got == brute(rows, lambda i: i % every == 0, how.get("positives", 5), how.get("share", (80, 100)))
    return got


def made(n: int, dims: int, labels: int, spread: float, seed: int) -> list[tuple]:
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(9, dims))
    return [(k, int(draw.integers(labels)), np.floor(100 * (centres[k % 9] + spread * draw.normal(size=dims))).tolist()) for k in range(n)]


@pytest.mark.parametrize("dims, spread", [(64, 0.3), (64, 3.0), (7, 1.0), (130, 1.0), (1, 1.0)])
def test_against_all_pairs(spark, dims, spread):
    assert compare(spark, made(300, dims, 3, spread, dims))


def test_in_blocks(spark, monkeypatch):
    for name, size in (("BLOCK_ROWS", 40), ("BLOCK_ANCHORS", 7), ("PAIRS", 90)):
        monkeypatch.setattr(hard_negatives, name, size)
    assert compare(spark, made(200, 16, 2, 0.5, 8))


def test_ties_and_copies(spark):
    rows = [(k, k % 2, [float(k % 3), 1.0, -2.0]) for k in range(80)]
    assert compare(spark, rows)
    assert compare(spark, [(k, k % 2, [5.0, 5.0]) for k in range(60)], share=(1, 1))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [3.0, 4.0]), (1, 1, [3.0, 3.0]), (2, 2, [3.0, 3.0]), (3, 2, None), (4, 2, []), (5, 2, [nan, 4.0]), (6, 2, [None, 4.0]), (7, 2, [inf, 1.0]),
            (8, None, [3.0, 4.0]), (None, 2, [3.0, 4.0]), (10, 1, [0.0, 0.0]), (11, 2, [0.0, 0.0]), (12, 1, [-3.0, -4.0]), (13, 2, [-3.0, -4.0]),
            (20, 5, [1.0, 1.0]), (30, 1, [3.0, 4.0, 5.0]), (31, 1, [3.0, 4.0, 5.0]), (32, 2, [3.0, 4.0, 4.0]), (2, 2, [3.0, 3.0]), (1, 1, [9.0, 3.0]),
            (40, 7, [1e20, 1.0]), (41, 7, [1e20, 1.0]), (42, 8, [2e20, 5.0]), (50, 7, [3e9, -1.0]), (51, 8, [3e9 - 1, 7.0]), (52, 8, [-1e30, 1e30])]
    assert compare(spark, rows)
    assert compare(spark, rows[:3], every=1000) == [(0, 1, 1, 2, 21, 21)]
    empty = spark.createDataFrame([], "vec_id long, label int, vector array<double>")
    assert hard_negatives.mine_negatives(empty, "vec_id = 0").collect() == []


def test_bounds_hold_and_tell():
    draw = np.random.default_rng(4)
    for dims in (1, 5, 64, 100):
        rows, asked = draw.normal(size=(500, dims)) * draw.exponential(size=(500, 1)), draw.normal(size=(40, dims))
        rows[0] = 0
        asked[0] = 0
        words, aligned, rest = hard_negatives.encode(rows)
        least, most = hard_negatives.Queries(asked).bounds(slice(0, 40), words, aligned, rest)
        exact = asked @ rows.T
        assert (least <= exact).all() and (exact <= most).all()
    # five codes leave about a tenth of a vector
    assert (rest / np.maximum(np.sqrt((rows**2).sum(1)), 1e-9)).mean() < 0.15


def test_scores_are_exact():
    left, right = np.array([[2.0**40, 3.0], [1e25, -1.0]]), np.array([[2.0**20, 5.0], [1e25, 1.0]])
    assert hard_negatives.scores(left[:1], right[:1]).tolist() == [2**60 + 15]
    assert hard_negatives.scores(left, right).tolist() == [2**60 + 15, (1 << 63) - 1]


def test_query_of_odd_embeddings(spark, tmp_path):
    rows = [(k, k % 4 if k % 5 else None, [0.25 * (k % 9), -0.001 * k, 1.0]) for k in range(300)] + [(301, 1, None), (302, 1, [None, 1.0, 2.0]), (400, 2, [3e38, 1.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in queries.op11_hard_negatives(spark, str(tmp_path)).collect())
    whole = [(i, None if label is None else (label + 1) % 10 if i % 7 == 0 else label,
              v and [None if x is None else float(np.floor(256 * float(np.float32(x)))) for x in v]) for i, label, v in rows]
    assert got == brute(whole, lambda i: i % 100 == 0)
