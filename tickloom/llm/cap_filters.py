"""Near duplicates of vectors by spherical-cap filters from structured random product codes.

After a random rotation a unit vector is split into blocks. Each block has a small random code of unit vectors;
a filter is one codeword per block, so a few codewords span very many filter directions. A vector belongs
to every filter whose direction it exceeds a threshold in; these are listed without trying all: the sums
of the first half of the blocks are matched with the sorted sums of the second half. Vectors meet in their filters; pairs
whose sign sketches are too far apart are dropped, the rest is verified by the exact cosine, each pair once. No pair is ever a row of a table.

There are a few such codes. They grow with the number of vectors n (16 n filters in all) and the thresholds are set so
that a vector has ``per_vector`` filters on average, so lists stay as long and filters as full at any size.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.components import classes_of, contracted
from tickloom.llm.shared import cut, gather_runs, tidy

BLOCKS = 4
# Codes with rotations of their own, and the filters a vector has on average in all of them together: a vector
# that one code happens to cover thinly has others.
CODES = 8
PER_VECTOR = 48
SKETCH_BITS = 256
# Members of a filter or a class that are compared as one block, at least and at most; one of any size is many pairs of blocks.
BLOCK_ROWS = 1024
MOST_ROWS = 16384


class Code:
    """The rotation, the codewords, the threshold and the sketch directions for vectors of one length."""

    def __init__(self, dims: int, n: int, per_vector: float = PER_VECTOR / CODES, number: int = 0, seed: int = 23):
        draw = np.random.default_rng([seed, dims, number])
        self.number = number
        self.dims, self.padded = dims, max(BLOCKS, -(-dims // BLOCKS) * BLOCKS)
        self.words = max(2, math.ceil((16.0 * max(n, 2) / CODES) ** (1 / BLOCKS)))
        self.rotation = np.linalg.qr(draw.normal(size=(self.padded, self.padded)))[0][:dims]
        width = self.padded // BLOCKS
        code = draw.normal(size=(BLOCKS, self.words, width))
        self.code = code / np.linalg.norm(code, axis=2, keepdims=True)
        self.threshold = self._threshold(draw, min(per_vector, self.words**BLOCKS / 2))

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = (x @ self.rotation).reshape(len(x), BLOCKS, -1)
        each = [parts[:, i] @ self.code[i].T for i in range(BLOCKS)]
        pair = lambda a, b: (a[:, :, None] + b[:, None, :]).reshape(len(x), -1)
        return pair(each[0], each[1]), pair(each[2], each[3])

    def _threshold(self, draw, wanted: float) -> float:
        x = draw.normal(size=(64, self.dims))
        first, second = self.halves(x / np.linalg.norm(x, axis=1, keepdims=True))
        second = np.sort(second, axis=1)
        low, high = 0.0, 4.0
        for _ in range(40):
            middle = (low + high) / 2
            found = np.mean([(len(s) - np.searchsorted(s, middle - f)).sum() for f, s in zip(first, second)])
            low, high = (middle, high) if found > wanted else (low, middle)
        return (low + high) / 2

    def filters(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector number, filter) of all filters whose threshold the unit vectors exceed; each vector's best filter is always in."""
        who, keys = [], []
        for start in range(0, len(x), 256):
            first, second = self.halves(x[start : start + 256])
            order = np.argsort(-second, axis=1)
            for i in range(len(first)):
                down = -second[i][order[i]]
                at = np.flatnonzero(first[i] >= min(self.threshold + down[0], first[i].max()))
                many = np.maximum(np.searchsorted(down, first[i][at] - self.threshold, side="right"), first[i][at] == first[i].max())
                picks = order[i][gather_runs(np.zeros(len(at), np.int64), many)]
                keys.append((np.repeat(at, many).astype(np.int64) * second.shape[1] + picks) * CODES + self.number)
                who.append(np.full(len(picks), start + i))
        if not keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(who), np.concatenate(keys)


def _sketch(x: np.ndarray, seed: int = 29) -> np.ndarray:
    """(n, words of 64 signs) against random planes."""
    planes = np.random.default_rng(seed).normal(size=(x.shape[1], SKETCH_BITS))
    return np.packbits(x @ planes > 0, axis=1).view(np.int64)


def _far(cosine: float) -> int:
    """Sign differences that a pair with that cosine exceeds less than once in a million."""
    p = math.acos(min(1.0, cosine)) / math.pi
    return math.ceil(SKETCH_BITS * p + 5 * math.sqrt(SKETCH_BITS * p * (1 - p))) + 1


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def profiles(vectors: DataFrame, codes: list[Code]) -> DataFrame:
    """(vec_id, keys, s0..s3): all filters and the sketch of every vector."""

    @tidy
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                x = _unit(_matrix(part.column("embedding")))
                who, keys = (np.concatenate(z) for z in zip(*(code.filters(x) for code in codes)))
                ends = np.cumsum(np.bincount(who, minlength=len(x)))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(keys[np.argsort(who, kind="stable")]))
                signs = _sketch(x)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), lists, *(pa.array(np.ascontiguousarray(signs[:, k])) for k in range(signs.shape[1]))],
                    ["vec_id", "keys", "s0", "s1", "s2", "s3"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, keys array<long>, s0 long, s1 long, s2 long, s3 long")


def _in_units(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` once for each pair of blocks (lo, hi) of their ``key`` that their own block is one of, pairs of blocks together and in order.

    A key has up to eight blocks of ``BLOCK_ROWS`` rows; beyond that blocks grow, so that rows are not repeated more often, up to ``MOST_ROWS``.
    """
    n = F.col("n")
    size = F.least(F.lit(max(MOST_ROWS, BLOCK_ROWS)), F.greatest(F.lit(BLOCK_ROWS), F.ceil(n / 8)))
    crowd = rows.groupBy(key).agg(F.count("*").alias("n")).filter(n > 1).select(key, F.ceil(n / size).cast("int").alias("blocks"))
    units = rows.join(crowd, key).withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("blocks", "other").withColumnRenamed(key, "key")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return units.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "vec_id")


def _whole_units(batches):
    """Tables of whole units (key, lo, hi) from rows in their order, with the unit number of each row."""

    def unit_of(held: pa.Table) -> np.ndarray:
        unit = np.stack([held.column(c).to_numpy() for c in ("key", "lo", "hi")], 1)
        return np.cumsum(np.append(False, (unit[1:] != unit[:-1]).any(1)))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) < 8 * BLOCK_ROWS:
            continue
        table = pa.Table.from_batches(held)
        unit = unit_of(table)
        whole = int(np.searchsorted(unit, unit[-1]))
        if whole:
            yield table.slice(0, whole).combine_chunks(), unit[:whole]
            table = table.slice(whole)
        held = table.combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table.combine_chunks(), unit_of(table)


# Rows up to which units are compared side by side.
_FEW = 32


def _near(far: int):
    """For rows in units (key, lo, hi): pairs (a, b) that join what the pairs join whose sketches differ in ``far`` signs at most.

    In a large unit a row is only compared with those that it is not joined to yet, so a group of near copies takes as many
    steps as it has members.
    """

    def links(signs: np.ndarray, group: np.ndarray):
        size = np.bincount(group)
        left = np.flatnonzero(size[group] <= _FEW)
        step = 1
        while True:
            left = left[left + step < len(group)]
            left = left[group[left] == group[left + step]]
            if not len(left):
                break
            on = left[np.bitwise_count(signs[left] ^ signs[left + step]).sum(1) <= far]
            yield on, on + step
            step += 1
        for first, count in zip((np.cumsum(size) - size)[size > _FEW], size[size > _FEW]):
            own, part = signs[first : first + count], np.arange(count)
            for i in range(count):
                others = i + 1 + np.flatnonzero(part[i + 1 :] != part[i])
                if not len(others):
                    break  # all that follow are joined
                on = others[np.bitwise_count(own[others] ^ own[i]).sum(1) <= far]
                if len(on):
                    part[np.isin(part, part[on])] = part[i]
                    yield np.full(len(on), first + i), first + on

    def pairs(batches):
        for held, group in _whole_units(batches):
            ids = held.column("vec_id").to_numpy()
            signs = np.stack([held.column(f"s{k}").to_numpy() for k in range(4)], 1).view(np.uint64)
            for a, b in links(signs, group):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(ids[a], ids[b])), pa.array(np.minimum(ids[a], ids[b]))], ["a", "b"])

    @tidy
    def run(batches):
        yield from contracted(pairs(batches))

    return run


def _in_common(lists: pa.ListArray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows ``a`` and ``b`` have a number in common; numbers that many rows have are looked at first, 64 at a time."""
    offsets = lists.offsets.to_numpy()
    row = np.repeat(np.arange(len(lists)), np.diff(offsets))
    _, code, many = np.unique(lists.values.to_numpy()[offsets[0] : offsets[-1]], return_inverse=True, return_counts=True)
    rank = np.empty(len(many), np.int64)
    rank[np.argsort(-many, kind="stable")] = np.arange(len(many))
    order = np.argsort(rank[code], kind="stable")[: int(many[many > 1].sum())]
    row, rank = row[order], rank[code][order]
    found, left = np.zeros(len(a), bool), np.arange(len(a))
    start = 0
    while start < len(rank) and len(left):
        end = int(np.searchsorted(rank, (rank[start] // 64 + 1) * 64))
        word = np.zeros(len(lists), np.uint64)
        np.bitwise_or.at(word, row[start:end], np.uint64(1) << (rank[start:end] % 64).astype(np.uint64))
        hit = (word[a[left]] & word[b[left]]) != 0
        found[left[hit]] = True
        left, start = left[~hit], end
    return found


# Cosines that are looked at at once; how far the product of two matrices may be from a sum of products.
_CELLS, _ROUNDING = 1 << 21, 1e-9


def _verified(cosine: float, far: int):
    """For rows in units: (a, n) with the copies linked to a vector in a unit, and (a, b) that join what the links join."""

    def linked(held: pa.Table, group: np.ndarray):
        """Each pair of rows once that is linked, as row numbers."""
        x = _matrix(held.column("embedding").chunk(0))
        x, unit = x / np.abs(x).max(1, keepdims=True), _unit(x)
        signs, own = _sketch(unit).view(np.uint64), held.column("own").to_numpy()
        cross = held.column("lo").to_numpy() != held.column("hi").to_numpy()
        square = (x * x).sum(1)
        for start in range(0, len(x), tile := max(1, _CELLS // len(x))):
            a, b = np.nonzero(unit[start : start + tile] @ unit[start:].T >= cosine - _ROUNDING)
            a, b = a + start, b + start
            on = (a < b) & (group[a] == group[b]) & (~cross[a] | (own[a] != own[b]))
            a, b = a[on], b[on]
            for k in range(0, len(a), _CELLS // 64):
                p, q = a[k : k + _CELLS // 64], b[k : k + _CELLS // 64]
                value = (x[p] * x[q]).sum(1) / (np.sqrt(square[p]) * np.sqrt(square[q]))
                on = (value >= cosine) & (np.bitwise_count(signs[p] ^ signs[q]).sum(1) <= far)
                p, q = p[on], q[on]
                if len(p):
                    on = _in_common(held.column("keys").chunk(0), p, q)
                    yield p[on], q[on]

    def chunks(held: pa.Table, group: np.ndarray):
        """A large unit alone, small ones by some hundred rows."""
        starts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
        first = 0
        for k in range(1, len(starts)):
            if k + 1 == len(starts) or starts[k + 1] - first > 512:
                yield held.slice(first, starts[k] - first).combine_chunks(), group[first : starts[k]]
                first = starts[k]

    def pairs(batches, counts: list[pa.RecordBatch]):
        for table, groups in _whole_units(batches):
            for held, group in chunks(table, groups):
                ids, copies = held.column("vec_id").to_numpy(), held.column("copies").to_numpy()
                n = np.zeros(len(ids), np.int64)
                for a, b in linked(held, group):
                    np.add.at(n, a, copies[b])
                    np.add.at(n, b, copies[a])
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(ids[a], ids[b])), pa.array(np.minimum(ids[a], ids[b]))], ["a", "b"])
                some = np.flatnonzero(n)
                counts.append(pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.nulls(len(some), pa.int64()), pa.array(n[some])], ["a", "b", "n"]))

    @tidy
    def run(batches):
        counts: list[pa.RecordBatch] = []
        for part in contracted(pairs(batches, counts)):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.nulls(part.num_rows, pa.int64())], ["a", "b", "n"])
            yield from counts
            counts.clear()
        yield from counts

    return run


def links_of(vectors: DataFrame, cosine: float, per_vector: int = PER_VECTOR) -> DataFrame:
    """(a, n) with the ``copies`` that a vector is linked to, in parts, and (a, b) with a > b that join what the links join.

    ``vectors`` (vec_id, embedding, copies) are distinct and usable. Links are too many to be rows: a group of m near vectors has m * m / 2, met
    in each filter that they share. So first the pairs with near sketches are contracted where they are met, to classes that
    hold all links. Then each pair of a class is looked at once, by blocks with the vectors and their filters at hand, and is a link
    if its cosine, its sketches and a filter in common say so. What leaves a task are counts and few links.
    """
    found = []
    sizes = vectors.groupBy(F.size("embedding").alias("dims")).count().collect()  # a row per vector length
    far = _far(cosine)
    for dims, n in sizes:
        own = vectors.filter(F.size("embedding") == dims)
        known = cut(profiles(own, [Code(dims, n, per_vector / CODES, k) for k in range(CODES)]))
        met = _in_units(known.select(F.explode("keys").alias("filter"), "vec_id", "s0", "s1", "s2", "s3"), "filter")
        classes = cut(classes_of(met.mapInArrow(_near(far), "a long, b long")).withColumnRenamed("node", "vec_id"))
        members = classes.join(own, "vec_id").join(known.select("vec_id", "keys"), "vec_id")
        found.append(_in_units(members, "class_id").mapInArrow(_verified(cosine, far), "a long, b long, n long"))
    none = vectors.select(F.col("vec_id").alias("a"), F.col("vec_id").alias("b"), F.col("vec_id").alias("n")).filter("false")
    return reduce(DataFrame.union, found, none)


def cap_filter_classes(vectors: DataFrame, cosine: float = 0.9, per_vector: int = PER_VECTOR) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding array).

    Two vectors of the same length are linked if their cosine in double precision is at least ``cosine`` and they share a filter.
    Vectors of equal components are linked without search and stand for one in it. A vector that is null or
    empty, all zero or holds a null or non-finite component is linked with nothing, not even its copies. ``component_id`` is the
    smallest id reachable by links, ``kept`` marks that row. Rows that repeat an id repeat their result and
    count as one vector; a null id is linked with nothing. An empty table gives no rows; other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = F.coalesce(
        F.col("vec_id").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("embedding", lambda v: v != 0), F.lit(False))
    good = rows.filter(usable).dropDuplicates(["vec_id"])
    firsts = cut(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    links = cut(links_of(firsts.select(F.col("rep").alias("vec_id"), "embedding", "copies"), cosine, per_vector))
    degree = links.filter("n IS NOT NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    found = classes_of(links.filter("n IS NULL")).withColumnRenamed("node", "rep")
    named = cut(firsts.join(degree, "rep", "left").join(found, "rep", "left").select(
        "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("class_id", "rep").alias("component_id")))
    out = rows.filter(usable).join(named, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
