"""Connected components of a link table, by joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import cut, cut_small, gathered, tidy

# Links a task contracts at once.
_HELD = 200_000


def _contract(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """As few links as join the same nodes: each node with the smallest of its component among these links."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, label[x], least)
        np.minimum.at(after, label[y], least)
        while (after[after] != after).any():
            after = after[after]
        after = after[label]
        if (after == label).all():
            break
        label = after
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[label[far]])], ["a", "b"])


def contracted(batches):
    """Batches of links (a, b) as fewer that join the same nodes; what is held at once is bounded."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= _HELD:
            held = _merge(held)
            if sum(x.num_rows for x in held) >= _HELD // 2:
                yield from held
                held = []
    if held:
        yield from _merge(held)


def _merge(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    # columns, not tables: links as Spark sends them cannot be null by their schema, contracted ones can
    return [_contract(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b")))]


# Links of a node from which on it is a hub, as a number and as a share of all links: there are at most 20,000 hubs.
_HUB, _HUB_SHARE = 1000, 1e-4


def _met(rows: DataFrame, table: DataFrame, key: str, links: int) -> DataFrame:
    """``rows`` joined to ``table`` (key, n, value) by ``key``; hubs, few by their definition, are sent to the rows instead."""
    hubs = F.broadcast(table.filter(F.col("n") > max(_HUB, int(links * _HUB_SHARE))).drop("n"))
    rest = rows.join(hubs.select(key), key, "left_anti").join(table.drop("n"), key)
    return rows.join(hubs, key).unionByName(rest)


def classes_of(links: DataFrame) -> DataFrame:
    """(node, class_id): the smallest node reachable from every node of ``links`` (a, b long), itself included.

    Links are first contracted within each partition. Then, in rounds, every node sends its
    larger neighbours to its smallest one, and its smaller neighbours to the smallest of them, until all
    components are stars. Links stay in tables and their partitions, and a node with a great share of them is no
    task of its own; those with a null end are ignored.
    """
    links = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    links = cut_small(links.mapInArrow(tidy(contracted), "a long, b long").distinct())
    while True:
        both = links.union(links.select("b", "a"))
        least = cut_small(both.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n")).select("a", "n", F.least("a", "least").alias("root")))
        # all are stars once every node with a smaller neighbour has no other
        seen = least.selectExpr("coalesce(sum(n) div 2, 0) AS links", "coalesce(bool_or(root < a AND n > 1), false) AS more").first()
        if not seen["more"]:
            break
        large = _met(both.filter("b > a"), least, "a", seen["links"]).select(F.col("b").alias("x"), F.col("root").alias("y")).distinct()
        large = cut(gathered(large, seen["links"]))
        to_least = large.groupBy("x").agg(F.min("y").alias("root"), F.count("*").alias("n"))
        small = _met(large, to_least, "x", seen["links"]).filter("y > root").select(F.col("y").alias("a"), F.col("root").alias("b"))
        links = cut(gathered(small.union(to_least.select("x", "root")).distinct(), seen["links"]))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("class_id")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("class_id")).union(roots)
