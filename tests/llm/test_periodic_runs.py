from __future__ import annotations

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tickloom.llm import periodic_runs, queries


def brute_runs(words: list, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by comparing the text with itself at every distance."""
    codes, n = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1], len(words)
    found, smaller = [], set()
    for q in range(1, n // times + 1):
        same = np.concatenate(([False], codes[q:] == codes[:-q], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            length = b - a + q
            if length >= max(least, times * q) and (a, length) not in smaller:
                smaller.add((a, length))
                found.append((a, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for a, k, q in runs for i in range(a + q, a + k)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{a},{k},{q}\n" for a, k, q in runs)),
            digest(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_random_words():
    draw = np.random.default_rng(3)
    for _ in range(300):
        docs = []
        for _ in range(draw.integers(1, 5)):
            words = draw.integers(0, draw.integers(1, 5), draw.integers(0, 90))
            if len(words) > 8 and draw.random() < 0.7:
                a = int(draw.integers(0, len(words)))
                words[a:] = words[a + np.arange(len(words) - a) % draw.integers(1, max(2, (len(words) - a) // 3 + 1))]
                words[draw.integers(0, len(words))] = draw.integers(0, 9)
            docs.append(words.tolist())
        starts = np.cumsum([0, *map(len, docs)])
        got = periodic_runs.runs_of(np.array(sum(docs, []), np.int64), starts)
        want = [(int(s) + a, int(s) + a + k, q) for d, s in zip(docs, starts) for a, k, q in brute_runs(d)]
        assert [tuple(r) for r in got.tolist()] == want


@pytest.mark.parametrize("words, runs", [
    ("a a a a a", []), ("a a a a a a", [(0, 6, 1)]), ("a b a b a b a b", [(0, 8, 2)]), ("a b a b a b a", []),
    ("x a b a b a b a b a y", [(1, 9, 2)]), ("a a a a a a b a a a a a a b a a a a a a b a a a a a a b", [(0, 6, 1), (0, 28, 7), (7, 6, 1), (14, 6, 1), (21, 6, 1)])])
def test_small(spark, words, runs):
    row = periodic_runs.find_runs(spark.createDataFrame([(1, words)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row["runs"]] == runs
    assert row["n_words"] == len(words.split())


def test_overlapping_runs_collapse(spark):
    text = "go " + "a " * 7 + "b c b c b c b c b end"
    row = periodic_runs.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["collapsed"] == "go a b c end"


def test_odd_rows(spark, odd, odd_rows, none):
    found = periodic_runs.find_runs(odd, places=periodic_runs.repeated_tail)
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = sorted((r["doc_id"] or -1, [tuple(x) for x in r["runs"]]) for r in found.collect())
    spelled = lambda i, t: brute_tail(i, re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    short = [(r[0], r[1]) for r in odd_rows if len(r[1] or "") < 50_000]
    want = sorted((i or -1, brute_runs(spelled(i, t))) for i, t in short)
    assert [g for g in got if g[0] not in (10, 11)] == [w for w in want if w[0] not in (10, 11)]
    assert len(got) == len(odd_rows)
    assert periodic_runs.find_runs(none).collect() == []


def brute_tail(doc_id, words):
    own = periodic_runs.repeated_tail(doc_id, len(words))
    return words if own is None else [words[i] for i in own]


def test_long_text(spark):
    text = "start " + "one two three " * 60_000 + "two"
    row = periodic_runs.find_runs(spark.createDataFrame([(7, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 180_000, 3)] and row["collapsed"] == "start one two three two"


def test_white_space_and_other_characters(spark):
    rows = [(3, "é é é é é é é é é é\x0bé é"), (4, "a\x1ca " * 6), (5, "A a " * 4), (6, "\x00 " * 9)]
    got = rows_of(periodic_runs.find_runs(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "runs"))
    assert [(i, [tuple(r) for r in runs]) for i, runs in got] == [(3, [(0, 6, 1)]), (4, [(0, 6, 1)]), (5, [(0, 8, 2)]), (6, [(0, 9, 1)])]


def test_query_on_odd_documents(spark, odd, odd_rows, tmp_path):
    odd.filter("length(text) < 50000 OR text IS NULL").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(queries.op12_periodic_runs(spark, str(tmp_path)))
    assert got == sorted((brute_row(r[0], r[1]) for r in odd_rows if len(r[1] or "") < 50_000), key=str)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.table(spark, sf, "documents").select("doc_id", "text").collect()
    got = queries.op12_periodic_runs(spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("n_runs", "bigint"), ("start", "bigint"), ("length", "bigint"), ("period", "bigint"),
                          ("exponent_milli", "bigint"), ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    assert rows_of(got) == sorted((brute_row(*r) for r in rows), key=str)


def test_refused():
    with pytest.raises(ValueError):
        periodic_runs.find_runs(None, times=3)
