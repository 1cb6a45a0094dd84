from __future__ import annotations

import math
import re

import pytest

from tickloom.llm import license_scan, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text: str | None, threshold: float = 0.9):
    words = WORD.findall((text or "").translate(LOWER))
    places = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(words))
              if words[i : i + len(phrase.split())] == phrase.split()]
    stride = max(len(t.split()) for _, t in license_scan.TEMPLATES)
    blocks = set()
    for s in range(0, max(len(words), 1), stride):
        held = set(words[s : s + 3 * stride])
        for label, t in license_scan.TEMPLATES:
            own = set(t.split())
            if len(held & own) >= math.ceil(threshold * len(own) - 1e-9):
                blocks.add((s, label, len(held & own) / len(own)))
    return len(words), sorted(places), sorted(blocks)


def check(rows, found):
    want = sorted((str(i), *brute(t)) for i, t in rows)
    got = sorted((str(r["doc_id"]), r["n_words"], sorted(map(tuple, r["places"])), sorted(map(tuple, r["blocks"]))) for r in found)
    assert got == want


def test_whole_table(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    check([(r["doc_id"], r["text"]) for r in docs.collect()], license_scan.scan_licenses(docs).collect())


def test_odd_rows(spark, odd, none, odd_rows):
    check([(r[0], r[1]) for r in odd_rows], license_scan.scan_licenses(odd).collect())
    assert license_scan.scan_licenses(none).count() == 0


def test_wrapped_and_changed_templates(spark):
    granted = license_scan.TEMPLATES[3][1]
    texts = ["x " * 37 + granted.replace(" ", "\n").upper(), granted.replace("charge", "cost"), granted.replace("charge", "cost").replace("free", "x"),
             "CC-BY 4.0, cc by; cc  by", "all rights reserved all rights reserved", "GNU General Public Licenses", "general public license"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = license_scan.scan_licenses(docs).collect()
    check(rows, found)
    by_id = {r["doc_id"]: r for r in found}
    assert {b["label"] for b in by_id[0]["blocks"]} == {"mit"} == {b["label"] for b in by_id[1]["blocks"]} and not by_id[2]["blocks"]
    assert len(by_id[3]["places"]) == 3 and by_id[3]["score"] == 1.0 and by_id[2]["score"] == 0.0


def test_grants_with_words_between(spark):
    """A grant of 16 words that spans up to 33, from every offset, and no letter but A-Z is lower-cased."""
    granted = license_scan.TEMPLATES[3][1].split()
    rows = []
    for every in (1, 2, 4, 8):
        spread = " ".join(w if k % every else f"rem {w}" for k, w in enumerate(granted))
        rows += [(every * 100 + before, "x " * before + spread + " y" * 40) for before in range(17)]
    rows += [(1, "all rights reserved, ALL RIGHTS RESERVED"), (2, "\u212aind cc by"), (3, "CC B\u0130")]
    found = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(rows, found)
    assert all({b["label"] for b in r["blocks"]} == {"mit"} for r in found if r["doc_id"] >= 100)


def test_query_columns(spark):
    rows = {r["doc_id"]: r for r in queries.op6_license_scan(spark, "/root/testdata/sf0.01").collect()}
    some = next(r for r in rows.values() if r["base_labels"] == "gpl")
    assert "gpl" in some["labels"].split(",") and some["first_word"] <= some["last_word"]
    plain = next(r for r in rows.values() if not r["labels"])
    assert plain["first_word"] is None and plain["n_base"] == 0 and plain["score"] == 0.0
    assert pytest.approx(1.0) == some["score"]
