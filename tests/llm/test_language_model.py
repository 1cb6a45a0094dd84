from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import language_model, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def check_base(rows, learn, got, total):
    counts = Counter(w for t in learn for w in tokens(t))
    n, v, left = counts.total(), len(counts), Counter()
    assert total == n
    for r in got:
        left[(r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6))] += 1
        assert math.isfinite(r["score"]) and r["score"] <= 0
    for i, t in rows:
        own = tokens(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        key = (i, len(own), sum(w in counts for w in own), round(base, 6))
        near = [k for k in left if k[:3] == key[:3] and left[k] and k[3] == pytest.approx(base, abs=1e-5)]
        assert near
        left[near[0]] -= 1


@pytest.mark.parametrize("frequent", [language_model.FREQUENT, 50])
def test_base_of_a_table(spark, monkeypatch, frequent):
    """Counts of all words, whether every task holds them or they are joined."""
    real = language_model.vocabulary
    monkeypatch.setattr(language_model, "vocabulary", lambda counts: real(counts, frequent))
    sf = "/root/testdata/sf0.01"
    docs = queries.table(spark, sf, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = queries.op10_log_bilinear(spark, sf).collect()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    assert all(r["held_out"] == held[r["doc_id"]] for r in got)
    check_base(rows, [t for i, t in rows if not held[i]], got, got[0]["train_tokens"])
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) + 0.1 * sum(r["n_tokens"] for r in out)


def test_normalised(spark):
    """Probabilities of all units sum to 1 after any context, and so do those of a class's words."""
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    texts = language_model.texts_of(docs)
    counts = language_model.count_tokens(texts)
    words = language_model.vocabulary(counts)
    model = language_model.train(texts, words)
    a, b = np.array([0, 3, 700, 5]), np.array([1, 700, 2, 5])
    logits = model.hidden(a, b) @ model.Q.T + model.bias
    assert np.exp(logits - model.log_normaliser(a, b)[:, None]).sum(1) == pytest.approx(np.ones(4), abs=1e-4)
    assert words.class_tokens.sum() + words.unit_counts[: language_model.SHORTLIST].sum() == words.total
    start = language_model.LogBilinear(words.unit_counts)
    gain = [m.noise @ (m.bias - m.log_normaliser(np.zeros(len(m.bias), int), np.zeros(len(m.bias), int))) for m in (start, model)]
    assert all(np.isfinite(gain))


def test_scores_of_a_table(spark):
    """Scores, word by word, from the model's parameters and plain counts."""
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    learn = docs.filter("doc_id % 3 > 0")
    texts = language_model.texts_of(learn)
    table = language_model.count_tokens(texts)
    words = language_model.vocabulary(table)
    model = language_model.train(texts, words)
    counts = Counter(w for i, t in rows if i % 3 for w in tokens(t))
    key = lambda w: language_model.END if w is None else w
    hashes = {w: language_model._hash([key(w)])[0] for i, t in rows for w in tokens(t)}
    short = {h: int(u) for h, u in zip(words.hashes.tolist(), words.units.tolist()) if u >= 0}
    kind = {w: int(language_model._classes([key(w)], np.array([h]))[0]) for w, h in hashes.items()}
    unit = {w: short.get(int(h), language_model.SHORTLIST + kind[w]) for w, h in hashes.items()}
    alone = {w: u < language_model.SHORTLIST for w, u in unit.items()}
    mass, once = Counter(), Counter()
    for w, c in counts.items():
        if not alone[w]:
            mass[kind[w]] += c
            once[kind[w]] += c == 1
    room = lambda k: mass[k] + once[k] + 1
    # all words of a class, and as many unseen ones as were seen once and one more, share it without rest
    for k in set(kind.values()):
        assert sum(c / room(k) for w, c in counts.items() if kind[w] == k and not alone[w]) + (once[k] + 1) / room(k) == pytest.approx(1)

    def brute(text):
        own, total, before = tokens(text), 0.0, [unit[None], unit[None]]
        for w in own:
            a, b = np.array([before[-2]]), np.array([before[-1]])
            logits = model.hidden(a, b) @ model.Q.T + model.bias
            total += float(logits[0, unit[w]] - np.logaddexp.reduce(logits[0].astype(float))) / math.log(10)
            total += 0.0 if alone[w] else math.log10(max(counts[w], 1) / room(kind[w]))
            before.append(unit[w])
        return total

    got = {r["doc_id"]: r["score"] for r in language_model.score_texts(docs, table, words, model).collect()}
    unseen = [i for i, t in rows if any(w not in counts for w in tokens(t))]
    assert unseen
    for i, t in [r for r in rows if r[0] % 5 == 0 or r[0] in unseen[:20]][:60]:
        assert got[i] == pytest.approx(brute(t), rel=1e-4, abs=1e-3)


def test_odd_rows(spark, odd, none, odd_rows):
    scores, total = language_model.fit_and_score(odd, odd.filter("doc_id < 12"))
    check_base([r[:2] for r in odd_rows], [t for i, t, *_ in odd_rows if i is not None and i < 12], scores.collect(), total)
    scores, total = language_model.fit_and_score(odd, none)
    assert total == 0 and scores.count() == len(odd_rows)
    assert language_model.fit_and_score(none, odd)[0].count() == 0
