"""Byte pages against plain slicing."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tickloom.operators import logs as L


def byte_slice(data: bytes, pos: int, offset: int) -> bytes:
    low, high = min(pos, pos + offset), max(pos, pos + offset)
    return data[max(low, 0) : max(min(high, len(data)), 0)]


def page(data: bytes, number: int, chunk: int, window: int, origin: str) -> bytes:
    start = chunk * (number - 1) if origin == "start" else len(data) - chunk * number
    body = byte_slice(data, start, chunk)
    if not body:
        return b""
    before, after = byte_slice(data, start, -window) if window else b"", byte_slice(data, start + chunk, window)
    if b"\n" in before:
        before = before[before.index(b"\n") + 1 :]
    return before + body + after.split(b"\n")[0]


def count(data: bytes, chunk: int) -> int:
    return max(math.ceil(len(data) / chunk), 1)


@pytest.fixture(scope="module")
def log() -> str:
    """2,249 bytes in 41 lines."""
    lines = [f"line {i:02d} " + "x" * (i * 7 % 80) for i in range(40)]
    text = "\n".join(lines) + "\n"
    return text + "y" * (2249 - len(text))


def test_page_counts(spark, log):
    df = spark.createDataFrame([(log,)], "text string")
    for chunk, pages in {1000: 3, 500: 5, 2249: 1, 2248: 2, 100: 23, 200: 12}.items():
        assert L.page_count(df, "text", chunk).first().page_count == pages
    empty = spark.createDataFrame([("",)], "text string")
    assert L.page_count(empty, "text", 1000).first().page_count == 1
    assert [bytes(r.block) for r in L.paginate(empty, "text", 10, 5).collect()] == [b""]


def test_ranges(spark, log):
    data = log.encode()
    df = spark.createDataFrame([(log,)], "text string")
    for pos, offset in [(500, 100), (500, -100), (-1, 100), (-1, -100), (0, 0), (2200, 500), (2249, 10),
                        (5000, 10), (5000, -10), (5000, -4000), (10**12, 5), (7, 0)]:
        got = bytes(L.read_range(df, "text", pos, offset).first().block)
        assert got == byte_slice(data, pos, offset), (pos, offset)


@pytest.mark.parametrize("origin", ["start", "end"])
@pytest.mark.parametrize("chunk, window", [(100, 0), (100, 100), (7, 3), (500, 128), (1, 1), (3000, 10)])
def test_pages_of_random_text(spark, log, origin, chunk, window):
    rng = random.Random(chunk)
    texts = [log, "", "\n", "\n\n\n", "é\n" * 30, "ab\ncd"]
    texts += ["".join(rng.choice("aé\n漢 ") for _ in range(rng.randint(0, 300))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    for source in (df, df.withColumn("text", F.encode("text", "UTF-8"))):
        got = {(r.id, r.page): (r.page_count, bytes(r.block))
               for r in L.paginate(source, "text", chunk, window, origin).collect()}
        want = {}
        for i, text in enumerate(texts):
            data = text.encode()
            for number in range(1, count(data, chunk) + 1):
                want[i, number] = (count(data, chunk), page(data, number, chunk, window, origin))
        assert got == want


@pytest.mark.parametrize("origin", ["start", "end"])
@pytest.mark.parametrize("segment", [1, 64, 333])
def test_runs_of_pages_join_up(spark, log, origin, segment, monkeypatch):
    monkeypatch.setattr(L, "SEGMENT", segment)
    texts = [log, "", "\n" * 90, "é\n" * 300, None]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    for chunk, window in [(100, 100), (7, 30), (33, 0), (1000, 5)]:
        got = {(r.id, r.page): (r.page_count, r.block if r.block is None else bytes(r.block))
               for r in L.paginate(df, "text", chunk, window, origin).collect()}
        want = {(4, 1): (1, None)}
        for i, text in enumerate(texts[:4]):
            data = text.encode()
            for number in range(1, count(data, chunk) + 1):
                want[i, number] = (count(data, chunk), page(data, number, chunk, window, origin))
        assert got == want


@pytest.mark.parametrize("origin", ["start", "end"])
def test_a_long_text_in_small_rows(spark, origin):
    line = "0123456789" * 9 + "\n"
    df = spark.range(1).select("id", F.repeat(F.lit(line), 230_000).alias("text"))  # 21 MB
    pages = L.paginate(df, "text", L.LOG_CHUNK, L.LOG_WINDOW, origin)
    data = (line * 230_000).encode()
    got = {r.page: bytes(r.block) for r in pages.collect()}
    assert got == {n: page(data, n, L.LOG_CHUNK, L.LOG_WINDOW, origin) for n in range(1, count(data, L.LOG_CHUNK) + 1)}


def test_single_pages(spark, log):
    df = spark.createDataFrame([(log,)], "text string")
    data = log.encode()
    for origin in ("start", "end"):
        for number in (1, 2, 3, 23):
            got = L.read_page(df, "text", number, 100, 100, origin).first().block
            assert bytes(got) == page(data, number, 100, 100, origin)
        assert L.read_page(df, "text", 24, 100, 0, origin).first().block is None
        assert L.read_page(df, "text", 0, 100, 0, origin).first().block is None
    with pytest.raises(ValueError):
        L.paginate(df, "text", 100, 0, "middle")


def test_navigation(spark):
    df = spark.createDataFrame([(1, 1), (1, 3), (2, 3), (3, 3)], "page bigint, page_count bigint")
    rows = {(r.page, r.page_count): (r.prev_page, r.next_page, r.last_page) for r in L.page_nav(df).collect()}
    assert rows == {(1, 1): (None, None, None), (1, 3): (None, 2, 3), (2, 3): (1, 3, 3), (3, 3): (2, None, 3)}


def test_replace(spark):
    df = spark.createDataFrame([("a.b\na.b a.b\nc",)], "text string")
    assert L.replace_in_lines(df, "text", "a.b", "$1").first().text == "$1\n$1 $1\nc"
    assert L.replace_in_lines(df, "text", "b\n", "-").first().text == "a.-a.b a.-c"
    assert L.replace_in_lines(df, "text", "b\na", "-").first().text == "a.b\na.b a.b\nc"
    with pytest.raises(ValueError):
        L.replace_in_lines(df, "text", "", "x")


def test_text_is_not_carried_past_the_explode(spark, log):
    df = spark.createDataFrame([(1, log)], "id bigint, text string")
    plan = L.paginate(df, "text", 100, 10)._jdf.queryExecution().executedPlan().toString()
    carried = re.findall(r"\), \[([^\[\]]*)\], false, \[_page#", plan)
    assert len(carried) == 1 and "id#" in carried[0] and "text#" not in carried[0]
