from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tickloom.llm import queries, winnowing


def brute(words: int, k: int, w: int, grams: list[int]) -> list[int]:
    """Positions by the definition: the rightmost least value of every window."""
    real = grams[: max(words - k + 1, min(words, 1))]
    value = [(g % (1 << 64)) >> 33 for g in real]
    picked = []
    for i in range(max(len(value) - w + 1, min(len(value), 1))):
        window = range(i, min(i + w, len(value)))
        least = min(value[j] for j in window)
        picked.append(max(j for j in window if value[j] == least))
    return sorted(set(picked))


def rolled(spark, words: list[list[str]], k: int) -> list[list[int]]:
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i long, w array<string>")
    hashes = {r[0]: r[1] for r in rows.select("i", F.transform("w", lambda x: F.xxhash64(x)).alias("h")).collect()}
    turn = lambda x, n: ((x << n) | (x >> (64 - n))) & (2**64 - 1) if n else x
    out = []
    for i, own in enumerate(words):
        h = [x % (1 << 64) for x in hashes[i]]
        grams = []
        for j in range(len(h)):
            g = 0
            for n in range(k):
                g ^= turn(h[j + n] if j + n < len(h) else 0, k - 1 - n)
            grams.append(g)
        out.append(grams)
    return out


@pytest.mark.parametrize(("k", "w"), [(5, 16), (3, 4), (1, 1), (2, 5)])
def test_positions_and_hashes(spark, odd_rows, k, w):
    texts = [t or "" for _, t, *_ in odd_rows if not t or len(t) < 5000]
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {r[0]: r[1] for r in frame.select("i", winnowing.fingerprint(F.col("text"), k, w)).collect()}
    words = [[x for x in re.split(r"[ \t-\r]+", t.lower()) if x] for t in texts]
    for i, grams in enumerate(rolled(spark, words, k)):
        positions = brute(len(words[i]), k, w, grams)
        assert [p["position"] for p in got[i]] == positions
        assert [p["hash"] % (1 << 64) for p in got[i]] == [grams[p] for p in positions]


def test_shared_run_is_found(spark):
    shared = " ".join(f"w{i}" for i in range(winnowing.WINDOW + winnowing.GRAM - 1))
    rows = spark.createDataFrame([(0, "a b c d " + shared + " e f"), (1, "x " * 40 + shared + " y" * 90)], "i long, text string")
    a, b = (set(p["hash"] for p in r[0]) for r in rows.orderBy("i").select(winnowing.fingerprint(F.col("text"))).collect())
    assert a & b


def edits(rows: list[tuple]) -> dict[int, str]:
    own = sorted((i, t or "") for i, t in rows)
    after = [*own[1:], own[0]]
    return {i: t[: len(t) - len(t) // 2] + n[: len(t) // 2] for (i, t), (_, n) in zip(own, after)}


def test_query_on_a_table(spark):
    """Edited texts by their definition, over all documents; equal texts have equal fingerprints."""
    sf = "/root/testdata/sf0.01"
    rows = queries.table(spark, sf, "documents").select("doc_id", "text").collect()
    want = edits([tuple(r) for r in rows])
    got = queries.op3_winnowing(spark, sf).collect()
    assert len(got) == len(rows)
    texts, prints = dict(map(tuple, rows)), {}
    for r in got:
        assert r["edited_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest()
        assert r["n_chars"] == len(texts[r["doc_id"]])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert prints.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        a, b = ({x.split("@")[0] for x in r[c].split()} for c in ("fingerprint", "edited_fingerprint"))
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_odd_rows(odd, none, odd_rows):
    got = winnowing.edit_prints(odd).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in odd_rows)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[4]["prints"] == [] and by_id[5]["prints"] == [] and by_id[4]["near_next"] == 1.0
    assert by_id[1]["near_next"] == 1.0 and by_id[1]["prints"] == by_id[2]["prints"]
    assert by_id[12]["n_chars"] == len("Ünï cödé ñandú 漢字 🙂 é")
    assert winnowing.edit_prints(none).count() == 0
