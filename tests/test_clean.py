"""Values, command lines, checks, names, times."""

from __future__ import annotations

import shlex

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import clean as C
from tickloom.functions.labels import age_label, duration_label
from tickloom.operators import quality


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i bigint, t string")
    return [r.v for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_integers(spark):
    texts = ["1", " 12 ", "+5", "-3", "007", "1abs", "", "1.5", "1L", None, "99999999999999999999", "1 2", "--1"]
    got = values(spark, texts, lambda c: C.int_or_else(c, -9))
    assert got == [1, 12, 5, -3, 7, -9, -9, -9, -9, -9, -9, -9, -9]


def test_booleans(spark):
    texts = ["true", "TRUE", "1", "yes", "false", "False", "0", "no", "", "t", "f", "off", " ", None]
    got = values(spark, texts, lambda c: C.bool_or_else(c, False))
    assert got == [True] * 4 + [False] * 5 + [True] * 4 + [False]
    assert values(spark, [None], lambda c: C.bool_or_else(c, None)) == [None]


def test_json(spark):
    schema = T.StructType([T.StructField("key", T.StringType())])
    default = F.struct(F.lit("none").alias("key"))
    texts = ['{"key": "value"}', "{}", "{broken", "", None, "{'key': 'value'}", '{"key": null}']
    got = values(spark, texts, lambda c: C.json_or_else(c, schema, default)["key"])
    assert got == ["value", None, "none", "none", "none", "none", None]
    array = T.ArrayType(T.LongType())
    assert values(spark, ["[1, 2]", "[1", None], lambda c: C.json_or_else(c, array)) == [[1, 2], None, None]


SHELL = [
    "", "a b c", "  a\t b\nc ", "a=1 b=2", "'it is' \"two words\"", 'a"b c"d', "a\\ b", 'x"\\"q\\" \\n"', "''",
    '"" a', "'a\\b'", '"a\\\\b"', "\\'", "é='ü ö'", "--conf \"a=b c\" d=e=f", "a'b'\"c\"d", "\\\\", '"$x `y`"',
    "'open", '"open', "tail\\", 'a "b', "it's", "a b",
]


def test_shell_words(spark):
    got = values(spark, SHELL, C.parse_args)
    for text, words in zip(SHELL, got):
        try:
            assert words == shlex.split(text), text
        except ValueError:
            assert words is None, text


def test_options(spark):
    texts = ["a=1 b=2 a=3 flag", 'name="x = y" e=', "=v", "a=1 'open"]
    assert values(spark, texts, C.parse_options) == [{"a": "3", "b": "2"}, {"name": "x = y", "e": ""}, {"": "v"}, None]


def test_memory_overrides_options(spark):
    row = spark.sql("SELECT 'spark.driver.memory=1g x=y' AS o, '8G' AS d, '4g' AS e").select(
        C.job_options("o", F.col("d"), F.col("e")).alias("m")).first()
    assert row.m == {"x": "y", "spark.driver.memory": "8g", "spark.executor.memory": "4g"}
    merged = spark.sql("SELECT map('a', 1, 'b', 2) AS l, map('b', 3, 'c', 4) AS r").select(
        C.merge_options("l", "r").alias("m")).first().m
    assert merged == {"a": 1, "b": 3, "c": 4}


@pytest.mark.parametrize("check, good, bad", [
    (C.is_memory, ["4g", "8G", "8gb", "1024m", "16mb", "2k", "1t", "3PB", "4g\n"],
     ["320b", "4", "g", "4 g", "-4g", "4gg", "4.5g", "", "4g\n\n", "4g\r"]),
    (C.is_master_url, ["spark://localhost:7077", "spark://a-b.c_d:1"],
     ["spark://localhost", "http://localhost:7077", "spark://:7077", "spark://h:7077/", "spark://é:1"]),
    (C.is_ui_url, ["http://localhost:8080", "https://192.168.99.1:443"], ["http://localhost", "ftp://h:1", "localhost:8080"]),
    (C.is_entrypoint, ["com.test.Main", "Main", "a_1.B2"], ["com.test.", ".Main", "com..Main", "com.test-Main", "", "com Main"]),
    (C.is_jar_path, ["/tmp/a.jar", "/A.JAR", "/.jar"], ["a.jar", "/tmp/a.txt", "", "/tmp/jar"]),
    (C.is_jdbc_url, ["jdbc:mysql://host:3306/db?user=u&password=p$%&"],
     ["jdbc:mysql://host/db?user=u&password=p", "jdbc:mysql://host:3306/db?user=u", "jdbc:mysql://h-1:3306/d?user=u&password=p",
      "jdbc:postgresql://host:3306/db?user=u&password=p"]),
    (C.is_priority, ["0", "10", " 3 "], ["-1", "x", "", "1.5"]),
])
def test_checks(spark, check, good, bad):
    assert values(spark, good, check) == [True] * len(good)
    assert values(spark, bad, check) == [False] * len(bad)


def test_uri_parts(spark):
    texts = ["spark://m.example.org:7077", "https://ui:443", "jdbc:mysql://db:3306/main?user=me&password=x", "http://ui", None]
    got = [None if v is None else tuple(v) for v in values(spark, texts, C.parse_uri)]
    assert got == [("m.example.org", 7077, None, None), ("ui", 443, None, None), ("db", 3306, "main", "me"), None, None]


def test_names(spark):
    rows = spark.createDataFrame([(1, " job "), (2, "  "), (2, None), (3, "\n"), (-5, "")], "k bigint, n string")
    got = [r.v for r in rows.select(C.canonical_name("n", "k").alias("v")).collect()]
    assert got[0] == "job" and got[1] == got[2] != got[3]
    import re
    assert all(re.fullmatch(r"[a-z]+-[a-z]+-[0-9]{4}", n) for n in got[1:])


def test_times(spark):
    row = spark.sql("SELECT 1449350000999L AS ms, -1L AS past").select(
        C.ms_to_ts("ms").cast("string").alias("ts"), C.ts_to_ms(C.ms_to_ts("ms")).alias("back"),
        C.ms_to_ts("past").cast("string").alias("past")).first()
    assert (row.ts, row.back, row.past) == ("2015-12-05 21:13:20", 1449350000000, "1969-12-31 23:59:59")


def test_duration_labels(spark):
    texts = ["0", "999", "1000", "59999", "60000", "61000", "3599999", "3600000", "7500000", None]
    assert values(spark, texts, lambda c: duration_label(c.cast("bigint"))) == [
        "0sec (0)", "0sec (999)", "1sec (1000)", "59sec (59999)", "1min 0sec", "1min 1sec", "59min 59sec",
        "1hrs 0min", "2hrs 5min", None]


def test_age_labels(spark):
    now = 1_700_000_000_000
    ages = [0, 1, 59_999, 60_000, 3_599_999, 3_600_000, 86_399_999, 86_400_000, -1]
    got = values(spark, [str(now - a) for a in ages], lambda c: age_label(c.cast("bigint"), now))
    assert got == ["2023-11-14 22:13:20", "less than a minute ago", "less than a minute ago", "1 minutes ago",
                   "59 minutes ago", "1 hours ago", "23 hours ago", "2023-11-13 22:13:20", "2023-11-14 22:13:20"]


def test_validation(spark):
    rows = [(1, "ACTIVE", 1), (2, "WRONG", 1), (3, "PAUSED", 0), (4, None, None)]
    df = spark.createDataFrame(rows, "uid bigint, status string, createtime bigint")
    valid, bad, counts = quality.validate(df, quality.timetable_rules())
    assert [r.uid for r in valid.collect()] == [1] and valid.columns == df.columns
    assert {r.uid: r.violations for r in bad.collect()} == {
        2: ["status"], 3: ["createtime"], 4: ["status", "createtime"]}
    assert {r.rule: r.rows for r in counts.collect()} == {"status": 2, "createtime": 2}
    address = spark.sql("SELECT 'spark://h:1' AS m, 'http://h:1' AS u, 'jdbc:' AS j")
    assert quality.tag_violations(address, quality.address_rules("m", "u", "j")).first().violations == ["jdbc_url"]


def test_json_is_read_whole_or_not_at_all(spark):
    """As ``json.loads`` reads, but that NaN and Infinity are no JSON."""
    import json

    texts = ['{"a":1}', '{"a":1} tail', "{'a':1}", '{"a":1,"a":2}', "[1]", "1", "", "  ", '{"a":1}]', '{"a":1},{"b":2}', "1],[2", '1,"x":2', "1}",
             '{"a":"x\ty"}', '{"a":01}', "nul", "null", ' {"a":1}\n', '{"a":1}}', '"s"', "{a:1}", '{"a":1,}', "[1,]", '{"a":"\\x"}', '{"a":.5}',
             '{"a":+1}', "// c\n{}", '1},"w":{"x":1', '1}]', '[1],"v":[2', "true false", '"a" "b"', '{"a":{"b":[1,{"c":null}]}}']

    def loads(text):
        try:
            json.loads(text)
        except ValueError:
            return False
        return True

    rows = spark.createDataFrame([(t,) for t in [*texts, None, '{"a":NaN}', "Infinity"]], "t string")
    got = {r.t: r.ok for r in rows.select("t", C.is_json("t").alias("ok")).collect()}
    assert got == {**{t: loads(t) for t in texts}, None: False, '{"a":NaN}': False, "Infinity": False}
