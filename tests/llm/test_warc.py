from __future__ import annotations

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tickloom.llm import queries, warc


def expected(rows):
    leaders = {}
    for i, _, h in rows:
        if len(b := (h or "").encode()) >= 1000 and i is not None:
            leaders[b] = max(leaders.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        lead = leaders.get(b)
        kind = ("response", None) if lead is None or lead == i else ("revisit", lead)
        out.append((str(i), len(b), hashlib.sha1(b).hexdigest(), *kind))
    return sorted(out, key=str)


def found(frame):
    return sorted(((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in frame.collect()), key=str)


ODD = [(1, "http://a.example.com/x", "a" * 1000), (5, "http://a.example.com/x", "a" * 1000), (3, None, "a" * 1000), (4, "x", "a" * 999), (6, "x", "a" * 999),
       (7, "", None), (8, "HTTP://user@WWW.Example.ORG:8080/p q?z=1#f", "é" * 500), (9, "http://[bad", "é" * 500), (10, "http://127.0.0.1/", ""),
       (None, "http://n", "a" * 1000), (11, "u" * 5000, "b" * 3_000_000), (12, "http://b\n/c\r\nd", "<p>\r\n\r\n</p>"), (5, "http://a.example.com/x", "a" * 1000)]


def test_keys():
    assert warc.url_key("http://www.Example.org:80/a/B?q=1#x") == "org,example,www)/a/B?q=1"
    assert warc.url_key("https://a.b:444") == "b,a:444)/" and warc.url_key(None) == "" and warc.url_key("http://10.0.0.1/x") == "10.0.0.1)/x"
    assert " " not in warc.url_key("a b") and warc.url_key("http://[bad") == "http://[bad"


def test_whole_table(spark):
    rows = [tuple(r) for r in queries.table(spark, "/root/testdata/sf0.01", "pages").select("page_id", "url", "html").collect()]
    assert found(queries.op1_warc_index(spark, "/root/testdata/sf0.01")) == expected(rows)


def test_odd_rows(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame(ODD, "page_id long, url string, html string").selectExpr("*", "1 AS key", "2 AS file", "'x' AS digest")
    assert found(warc.round_trip(pages.repartition(3), str(tmp_path / "w"))) == expected(ODD)
    assert warc.round_trip(pages.filter("false"), str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("lines", [1, 3, 1000])
def test_index_finds_every_key_and_no_other(spark, tmp_path, lines):
    rows = [(k, f"http://h{k % 7}.example.com/{k % 40}", "x") for k in range(300)] + [(k % 5, "http://same.org/", "x") for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    captures = warc.write_archives(pages, str(tmp_path / "a"))
    index = warc.write_index(captures, str(tmp_path / "i"), lines)
    held = sorted(tuple(r) for r in captures.collect())
    assert sorted(tuple(r) for r in warc.look_up(index, captures.select("key")).collect()) == held
    wanted = spark.createDataFrame([(held[3][0],), ("",), ("zzz -",), (held[-1][0] + "0",), (held[0][0][:-1],), (None,)], "key string")
    assert sorted(tuple(r) for r in warc.look_up(index, wanted).collect()) == [h for h in held if h[0] == held[3][0]]
    directory = json.loads(open(index.first()["file"] + ".dir").read())
    assert [d[0] for d in directory] == sorted(d[0] for d in directory)


def test_archives_are_plain_warc(spark, tmp_path):
    pages = spark.createDataFrame(ODD[:2], "page_id long, url string, html string").coalesce(1)
    captures = warc.write_archives(pages, str(tmp_path))
    text = gzip.open(captures.first()["file"]).read().decode()
    assert text.count("WARC/1.1\r\n") == 3 and "WARC-Type: revisit" in text and "WARC-Refers-To: <urn:page:5>" in text
    payload = warc.read_records(captures.filter(F.col("page_id") == 5), payloads=True).first()["payload"]
    assert bytes(payload) == b"a" * 1000
