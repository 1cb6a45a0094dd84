from __future__ import annotations

from tickloom.llm.components import classes_of
from tickloom.llm.shared import cut


def test_more_links_than_a_task_holds(spark):
    """One task has several times the links that it contracts at once, as a table: Spark knows then that they are not null."""
    n, members = 70_000, 7
    nodes = spark.range(10 * n, numPartitions=1).selectExpr(f"id % {n} AS id")
    found = classes_of(cut(nodes.selectExpr(f"id - id % {members} + greatest(id % {members}, 1) AS a", f"id - id % {members} AS b")))
    assert found.count() == n
    assert found.filter(f"class_id <> node - node % {members}").count() == 0


def test_chain_and_nulls(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(10, 40)] + [(100, 101), (None, 5), (7, None), (3, 3)], "a long, b long")
    got = {r["node"]: r["class_id"] for r in classes_of(links.repartition(5)).collect()}
    assert got == {**dict.fromkeys(range(10, 41), 10), 100: 100, 101: 100}
