from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import spread


def test_packed_join(spark):
    """Repeated and null keys, rows of one side only, lists and maps beside the keys; as Spark's own join."""
    left = spark.range(4000, numPartitions=5).selectExpr(
        "nullif(id % 300, 7) AS k", "nullif(id div 10 % 50, 3) AS t", "concat('n', id) AS name", "array(id, null) AS list", "map('x', id) AS pairs")
    right = spark.range(3000, numPartitions=3).selectExpr("nullif(id % 400, 7) AS k", "id % 60 AS t", "if(id % 5 = 0, null, id) AS n")
    rows = lambda df: sorted(map(str, df.select("k", "t", "name", "list", "pairs", "n").collect()))
    by = [F.col("k"), F.shiftright("t", 3)]
    want = rows(left.join(right, ["k", "t"]))
    assert len(want) > 400
    assert rows(spread.packed_join(left, right, ["k", "t"], by)) == want
    assert rows(spread.packed_join(left, right.filter("false"), ["k", "t"], by)) == []
    assert rows(spread.packed_join(left.filter("false"), right, ["k", "t"], by)) == []


def test_packed_rows_are_small(spark, tmp_path):
    """What travels is less than a third of what a join would shuffle."""
    rows = spark.range(200_000, numPartitions=2).selectExpr(
        "id div 1000 AS k", "1704067200000 + id % 1000 * 60000 AS t", "concat('Customer#', id div 1000, '-T-', 1704067200000 + id % 1000 * 60000) AS name")
    packed = spread._pack(rows, F.pmod(F.xxhash64("k"), F.lit(4)).cast("int"))
    assert packed.selectExpr("sum(length(packed))").first()[0] < 200_000 * 10


def test_tiles_grow_with_the_pairs(spark, monkeypatch):
    """Rows are repeated as often as a bounded number of tiles asks for, not once for each million pairs."""
    monkeypatch.setattr(spread, "_TILES", 1)
    left = spark.range(3000).selectExpr("1 AS k", "id AS a")
    right = spark.range(3000).selectExpr("1 AS k", "id AS b")
    sizes = spark.createDataFrame([(1, 3000, 3000)], "k int, lefts long, rights long")
    dealt = []
    monkeypatch.setattr(spread, "spread", lambda df, *keys: dealt.append(df) or df)
    joined = spread.tiled_join(left, right, "k", sizes, most=100)
    assert joined.agg(F.count("*"), F.sum(F.col("a") * 3000 + F.col("b"))).first()[:] == (9_000_000, sum(range(9_000_000)))
    # 8 partitions: tiles of 1,125,000 pairs, three by three
    assert [df.count() for df in dealt] == [9000, 9000]
