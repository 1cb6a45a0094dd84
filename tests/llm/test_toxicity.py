from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from conftest_text import text_of
from tickloom.llm import queries, toxicity

BAD = ["grubnak", "zolfired", "vextor"]


def labelled(n: int):
    """Texts of which every fourth holds two or more bad words."""
    rows = []
    for k in range(n):
        words = text_of(k, 40 + k % 50).split()
        if k % 4 == 0:
            for j in range(2 + k % 3):
                words[(k * 7 + j * 11) % len(words)] = BAD[(k + j) % 3]
        rows.append((k, " ".join(words), int(k % 4 == 0)))
    return rows


def brute_marginals(score, starts, start, moves):
    """By the sum over all taggings."""
    up, down, stay = moves
    step = {(0, 0): 0.0, (0, 1): up, (1, 0): down, (1, 1): stay}
    out = []
    for a, b in itertools.pairwise(starts):
        total, on = 0.0, np.zeros(b - a)
        for tags in itertools.product((0, 1), repeat=b - a):
            w = sum(s for s, t in zip(score[a:b], tags) if t) + (start if tags and tags[0] else 0.0)
            w = math.exp(w + sum(step[p] for p in itertools.pairwise(tags)))
            total += w
            on += w * np.array(tags)
        out += [math.log(x / (total - x)) for x in on]
    return np.array(out)


def test_marginals_against_all_taggings():
    draw = np.random.default_rng(1)
    starts = np.array([0, 3, 3, 9, 10, 18])
    score = draw.normal(0, 2, 18)
    got, _, _ = toxicity.marginals(score, starts, -0.5, (0.3, -0.7, 1.1))
    assert got == pytest.approx(brute_marginals(score, starts, -0.5, (0.3, -0.7, 1.1)))


def test_held_out_texts_and_offsets(spark):
    rows = labelled(800)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 600], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    for r in toxicity.score_documents(docs, model).collect():
        if r["doc_id"] >= 600:
            assert (r["score"] >= 0.3) == bool(rows[r["doc_id"]][2])
        for span in r["spans"]:
            assert rows[r["doc_id"]][1][span["start"] : span["end"]] in BAD
    assert sorted(r["doc_id"] for r in toxicity.keep_clean(docs, model).collect()) == [r[0] for r in rows if not r[2]]


def test_query_on_a_table(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.op2_toxic_spans(spark, sf).collect()}
    marks = dict(queries.table(spark, sf, "labels").select("doc_id", "toxic").collect())
    assert len(got) == queries.table(spark, sf, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [(r["predicted"], marks[i]) for i, r in got.items() if r["held_out"] and i in marks]
    right = sum(p and y for p, y in held)
    assert right >= 0.9 * sum(y for _, y in held) and right >= 0.9 * sum(p for p, _ in held)


def test_odd_rows(spark, odd, none, odd_rows):
    model = toxicity.fit([r[1] for r in labelled(200)], [r[2] for r in labelled(200)])
    got = toxicity.score_documents(odd, model).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in odd_rows)
    empty = {r["score"] for r in got if r["doc_id"] in (4, 5, 6, 7)}
    assert len(empty) == 1 and empty.pop() < 0.3
    kept = toxicity.keep_clean(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows)
    assert toxicity.score_documents(none, model).count() == 0 and toxicity.keep_clean(none, model).count() == 0
    untaught = toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_documents(odd, untaught).filter("score >= 0.3").count() == 0
    assert toxicity.fit([], []).weights == {} and pa.array([]) is not None
