from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from conftest_text import text_of
from tickloom.llm import components, near_copies, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None) -> Counter:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return Counter(tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))) if words else Counter()


def like(a: Counter, b: Counter) -> float:
    shared = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return shared / max(a.total() + b.total() - shared, 1)


def brute(rows: list[tuple]) -> dict[int, int]:
    first: dict[str, int] = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        first.setdefault(t or "", i)
    bags = {i: shingles(t) for t, i in first.items()}
    label = {i: i for i in bags}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(bags)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            small, large = sorted((bags[a].total(), bags[b].total()))
            if small and small >= 0.8 * large and like(bags[a], bags[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(first[t or ""]) for i, t in rows}


def classes(frame) -> dict:
    got = frame.collect()
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["class_id"]) for r in got)
    return {r["doc_id"]: r["class_id"] for r in got}


def test_whole_table(spark):
    rows = [tuple(r) for r in queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    assert classes(queries.op7_near_copies(spark, "/root/testdata/sf0.01")) == brute(rows)


def test_groups_chains_and_shared_passages(spark):
    """A crowd of near copies, a chain whose ends are unlike, and texts that share a passage only."""
    base, passage = text_of(1, 120).split(), text_of(2, 60)
    rows = [(k, " ".join([*base[: k % 100], f"x{k}", *base[k % 100 + 1 :]])) for k in range(150)]
    chain = text_of(3, 100).split()
    for k in range(8):
        rows.append((200 + k, " ".join(chain)))
        chain = chain[6:] + [f"c{k}w{j}" for j in range(6)]
    rows += [(300 + k, text_of(40 + k, 60) + " " + passage) for k in range(30)]
    rows += [(400, rows[5][1]), (401, rows[5][1].upper())]
    got = classes(near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert got == brute(rows)
    assert len({got[k] for k in range(150)}) == 1 and len({got[300 + k] for k in range(30)}) == 30


def test_copies_far_from_the_heads_of_their_buckets(spark):
    """Pairs of near copies among many texts that are drawn from the same lines and so share buckets."""
    draw, lines, rows = np.random.default_rng(11), [text_of(500 + k, 20) for k in range(34)], []
    for _ in range(200):
        own = np.sort(draw.choice(30, 22, replace=False))
        rows.append((int(draw.integers(1 << 40)), "\n".join(lines[j] for j in own)))
        own[draw.choice(22, 2, replace=False)] = 30 + draw.choice(4, 2, replace=False)
        rows.append((int(draw.integers(1 << 40)), "\n".join(lines[j] for j in own)))
    got = classes(near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), bands=24))
    assert got == brute(rows)


def test_signatures_estimate_weighted_jaccard():
    a, b = "p q r s t u v w x y " * 3 + text_of(7, 40), "p q r s t u v w x y " * 5 + text_of(7, 30)
    doc, shingle, count = near_copies.bags(pa.array([a, b]))
    found = near_copies.signatures(doc, shingle, count, 2, 4096)
    assert np.mean(found[0] == found[1]) == pytest.approx(like(shingles(a), shingles(b)), abs=0.03)


def test_bands_miss_few_links():
    """A pair at the wanted likeness shares no band with a probability below one in ten thousand."""
    assert (1 - near_copies.LIKENESS**near_copies.ROWS) ** near_copies.BANDS < 1e-4


def test_odd_rows(odd, none):
    got = [tuple(r) for r in near_copies.near_copies(odd).collect()]
    want = {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8, 9: 8, 10: 10, 11: 10, 12: 12, 13: 13, 14: 14, 15: 14, None: None}
    assert {r[0]: r[1] for r in got} == want and len(got) == 17
    assert near_copies.near_copies(none).count() == 0


def test_components(spark):
    draw = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in draw.integers(0, 4000, (2500, 2))] + [(k, k + 1) for k in range(5000, 5300)]
    pairs += [(9000, 9000 + k) for k in range(1, 800)] + [(None, 1), (7, 7)]
    label = {}

    def root(i):
        while label.setdefault(i, i) != i:
            i = label[i]
        return i

    for a, b in pairs:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            label[y] = x
    links = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    assert {r[0]: r[1] for r in components.classes_of(links).collect()} == {i: root(i) for i in list(label)}
    assert components.classes_of(links.filter("false")).count() == 0


def test_a_crowd_of_near_copies_takes_a_pair_a_text(spark, monkeypatch):
    """What is compared stays near the number of texts, not a multiple of it."""
    pairs, plain = [], near_copies.compare
    monkeypatch.setattr(near_copies, "compare", lambda p, *more: (pairs.append(p.count()), plain(p, *more))[1])
    base = text_of(9, 120).split()
    rows = [(k, " ".join([*base[: k % 110], f"x{k}", *base[k % 110 + 1 :]])) for k in range(600)]
    got = classes(near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert set(got.values()) == {0} and sum(pairs) < 1.3 * len(rows)


def test_short_forms_never_say_too_little():
    draw = np.random.default_rng(6)
    for size in (1, 30, 500, 9000):
        a, b = (np.unique(draw.integers(0, 1 << 63, size).astype(np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([b[: size // 5], a[: size - size // 5]]))
        short = near_copies.bound(near_copies.shortened(a), near_copies.shortened(b))
        assert short >= near_copies.likeness(a, b) - 1e-12
        if size < 1000:
            assert short < near_copies.likeness(a, b) + 0.05


def test_a_crowd_with_strays_takes_few_pairs_a_text(spark, monkeypatch):
    """Texts at and beyond the edge of a crowd are settled with few pairs too, and all links are found."""
    pairs, plain = [], near_copies.compare
    monkeypatch.setattr(near_copies, "compare", lambda p, *more: (pairs.append(p.count()), plain(p, *more))[1])
    draw, base, rows = np.random.default_rng(17), text_of(12, 150).split(), []
    for k in range(500):
        own = list(base)
        for at in draw.choice(150, int(draw.integers(1, 9)), replace=False):
            own[at] = f"x{k}y{at}"
        rows.append((k, " ".join(own)))
    got = classes(near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert got == brute(rows) and 50 < len(set(got.values())) < 450
    assert sum(pairs) < 12 * len(rows), pairs
