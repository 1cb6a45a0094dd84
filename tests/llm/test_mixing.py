from __future__ import annotations

import re
from collections import defaultdict

import pytest

from tickloom.llm import mixing, queries


def targets(sizes: dict, share=1.5, most=2.0) -> dict:
    """By handing the excess on until no target is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    out, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        heavy = sum(weight[s] for s in open_)
        part = {s: left * weight[s] / heavy for s in open_}
        left = 0.0
        for s in list(open_):
            out[s] += part[s]
            if out[s] > most * sizes[s]:
                left += out[s] - most * sizes[s]
                out[s] = most * sizes[s]
                open_.discard(s)
    return out


def check(rows, got):
    size_of = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size_of(t)
    want, taken = targets(dict(sizes)), defaultdict(int)
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), size_of(t)) for i, t, _ in rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["epochs"] * r["size"] <= r["taken"]
        taken[r["source"]] += r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= 1


def test_whole_table(spark):
    docs, labels = (queries.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    first = mixing.mix_sources(docs, labels).collect()
    check([tuple(r) for r in docs.select("doc_id", "text", "source").collect()], first)
    again = mixing.mix_sources(docs.repartition(5), labels).collect()
    key = lambda r: (r["doc_id"], r["taken"], r["whole"])
    assert sorted(map(key, first)) == sorted(map(key, again))
    # documents of labelled quality are taken more often than others
    marks = dict(labels.select("doc_id", "quality").collect())
    rate = lambda q: sum(r["taken"] for r in first if marks.get(r["doc_id"]) == q) / sum(r["size"] for r in first if marks.get(r["doc_id"]) == q)
    assert rate(1) > rate(0)


def test_many_buckets_of_one_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 16)
    rows = [(k, "w " * (k % 9), "big" if k % 3 else "small") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(rows, mixing.mix_sources(docs).collect())


def test_odd_rows(odd, none, odd_rows):
    found = mixing.mix_sources(odd)
    check([(i, t, s) for i, t, s, _ in odd_rows], found.collect())
    assert mixing.mix_sources(none).count() == 0
    distinct = odd.dropDuplicates(["doc_id"])
    mix = mixing.mix_sources(distinct)
    whole = {r["doc_id"]: r["whole"] for r in mix.collect()}
    repeated = mixing.repeat_rows(distinct, mix)
    assert repeated.columns == odd.columns
    counts = {r["doc_id"]: r["count"] for r in repeated.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in whole.items() if n}


def test_rows_without_an_id_and_repeated_ids(spark):
    """Rows are repeated as often as the mix takes them, though they share an id or have none."""
    rows = [(None, f"w{k} " * (k % 7 + 1), "a" if k % 2 else "b") for k in range(300)]
    rows += [(7, f"v{k} " * (k % 5 + 1), "a") for k in range(40)] + [(None, "one two three", "c")] * 101 + [(None, None, None), (None, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    mix = mixing.mix_sources(docs)
    got = mix.collect()
    check(rows, got)
    assert len({r["taken"] / r["size"] for r in got if r["source"] == "a" and r["doc_id"] is None}) > 1
    want, sizes = defaultdict(int), defaultdict(int)
    for r in got:
        want[r["source"]] += r["size"] * r["whole"]
    found = mixing.repeat_rows(docs, mix).collect()
    for r in found:
        sizes[r["source"]] += len((r["text"] or "").split())
    assert len(found) == sum(r["whole"] for r in got) and dict(sizes) == {s: n for s, n in want.items() if n}
