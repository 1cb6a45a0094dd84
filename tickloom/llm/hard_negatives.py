"""Hard negatives by rotated one-bit codes.

A vector v is turned by a random rotation and only the signs are kept: a code vector x of length one. Stored beside it are
its alignment s = <v, x> and the length of what is left, v - s x. The rest gets another rotation and code, so that a few codes
leave a short rest r. For a query q then <v, q> = sum of s_j <x_j, q> + <r, q>.

The turned query is rounded to levels of a few bits; popcounts of code and bit planes give <x_j, q> but for the rounding, and
Cauchy-Schwarz bounds the rounding by s_j times its length, the rest by |r| |q|. The bounds are sure, not likely: a row is left
out only where its whole interval is, and the rows that remain are scored in integers. So results are exact.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import cut, tidy

# Codes a vector has, and bits a component of a query is rounded to.
CODES, PLANES = 5, 6
# Rows and anchors that meet in one group at most, about; the fewest rows worth a group; pairs bounded at once.
BLOCK_ROWS, BLOCK_ANCHORS, LEAST_ROWS, PAIRS = 16_384, 16_384, 1024, 1 << 18
_LONG = (1 << 63) - 1
_CODED = "vec_id long, label int, vector binary, codes binary, aligned binary, rest double"


@functools.lru_cache(maxsize=64)
def _rotation(dims: int, k: int) -> np.ndarray:
    draw = np.random.default_rng([dims, k])
    q, r = np.linalg.qr(draw.normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    padded = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def encode(vectors: np.ndarray, codes: int = CODES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes as words [row, code, word], alignments [row, code], length of the rest) of the rows of ``vectors``."""
    n, dims = vectors.shape
    rest, words, aligned = vectors.astype(np.float64), [], np.zeros((n, codes))
    for k in range(codes):
        turned = rest @ _rotation(dims, k)
        signs = turned >= 0
        code = np.where(signs, 1.0, -1.0) / np.sqrt(dims)
        aligned[:, k] = (turned * code).sum(1)
        rest = (turned - aligned[:, k : k + 1] * code) @ _rotation(dims, k).T
        words.append(_packed(signs))
    return np.stack(words, 1), aligned, np.sqrt((rest * rest).sum(1))


class Queries:
    """The rounded, turned forms of some query vectors of one length."""

    def __init__(self, vectors: np.ndarray, codes: int = CODES, planes: int = PLANES):
        self.length = np.sqrt((vectors * vectors).sum(1))
        dims, self.planes, self.low, self.step, self.total, self.error = vectors.shape[1], [], [], [], [], []
        self.root = np.sqrt(dims)
        for k in range(codes):
            turned = vectors @ _rotation(dims, k)
            low = turned.min(1, keepdims=True)
            step = (turned.max(1, keepdims=True) - low) / ((1 << planes) - 1)
            level = np.rint((turned - low) / np.where(step > 0, step, 1)).astype(np.int64)
            rounded = low + step * level
            self.planes.append([_packed(level >> p & 1 == 1) for p in range(planes)])
            self.low.append(low[:, 0])
            self.step.append(step[:, 0])
            self.total.append(rounded.sum(1))
            self.error.append(np.sqrt(((turned - rounded) ** 2).sum(1)))

    def bounds(self, at: slice, words: np.ndarray, aligned: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) inner product of the queries ``at`` with coded rows, one row of the result per query."""
        count = lambda x: np.bitwise_count(x).sum(-1, dtype=np.int32) if x.shape[-1] > 1 else np.bitwise_count(x[..., 0])
        length = self.length[at, None]
        middle, radius = np.zeros((len(length), len(rest))), rest[None, :] * length
        for k in range(words.shape[1]):
            code, ones = words[:, k], count(words[:, k]).astype(np.float64)
            levels = np.zeros(middle.shape, np.int32)
            for p, plane in enumerate(self.planes[k]):
                levels += count(plane[at, None, :] & code[None]).astype(np.int32) << p
            inside = self.low[k][at, None] * ones + self.step[k][at, None] * levels
            middle += aligned[:, k] * (2 * inside - self.total[k][at, None]) / self.root
            radius += np.abs(aligned[:, k]) * self.error[k][at, None]
        # room for rounding in the sums above
        radius += 1e-9 * (radius + length * (rest + np.abs(aligned).sum(1))) + 1e-6
        return middle - radius, middle + radius


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows as long; what is beyond its range is its end."""
    if not len(left):
        return np.zeros(0, np.int64)
    most = np.sqrt((left * left).sum(1).max()) * np.sqrt((right * right).sum(1).max())
    if most < 1 << 62 and max(np.abs(left).max(), np.abs(right).max()) < 1 << 62:
        if most < 1 << 52:
            return np.einsum("ij,ij->i", left, right).astype(np.int64)
        return np.einsum("ij,ij->i", left.astype(np.int64), right.astype(np.int64))
    exact = ([int(a) * int(b) for a, b in zip(x, y)] for x, y in zip(left.tolist(), right.tolist()))
    return np.array([min(max(sum(x), -_LONG - 1), _LONG) for x in exact], np.int64)


def _first(groups: np.ndarray, ids: np.ndarray, score: np.ndarray, count: int) -> np.ndarray:
    """The places of the first ``count`` rows of every group, by score downward, then id."""
    order = np.lexsort((ids, -score.astype(object) if len(score) and score.min() == -_LONG - 1 else -score, groups))
    ordered = groups[order]
    start = np.searchsorted(ordered, ordered)
    return order[np.arange(len(order)) - start < count]


class _Rows:
    """Coded rows of one vector length, by label."""

    def __init__(self, table: pa.Table, dims: int):
        n, codes = table.num_rows, CODES
        of = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        self.ids, self.labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy().astype(np.int64)
        self.vectors = of("vector", np.float64).reshape(n, dims)
        self.words = of("codes", np.uint64).reshape(n, codes, -1)
        self.aligned, self.rest = of("aligned", np.float64).reshape(n, codes), table.column("rest").to_numpy()


def _by_length(table: pa.Table) -> dict[int, pa.Table]:
    """The rows of every vector length."""
    table = table.sort_by([("label", "ascending"), ("vec_id", "ascending")])
    dims = np.array([len(v) // 8 for v in table.column("vector").to_pylist()], np.int64)
    return {int(d): table.take(pa.array(np.flatnonzero(dims == d))) for d in np.unique(dims)}


def _kept_pairs(rows: _Rows, anchors: _Rows, meet: list[tuple[slice, slice]], allowed, keep):
    """(anchor places, row places, scores) of the pairs that ``keep`` leaves by their bounds, some anchors at a time.

    ``meet`` are stretches of anchors and of rows that meet; ``allowed`` which pairs of places (anchors in a column, rows) may
    count at all; ``keep`` which of them may be wanted, given the anchors' places and the bounds, endless ones where not allowed.
    """
    queries = Queries(anchors.vectors)
    for theirs, mine in meet:
        near = np.arange(mine.start, mine.stop)
        step = max(1, PAIRS // max(1, len(near)))
        for a in range(theirs.start, theirs.stop, step):
            at = slice(a, min(a + step, theirs.stop))
            places = np.arange(at.start, at.stop)
            least, most = queries.bounds(at, rows.words[mine], rows.aligned[mine], rows.rest[mine])
            # scores end where a long ends, so their bounds do
            least, most = np.minimum(least, float(_LONG)), np.maximum(most, -float(_LONG))
            wanted = allowed(places[:, None], near)
            least[~wanted], most[~wanted] = -np.inf, -np.inf
            x, y = np.nonzero(wanted & keep(places, least, most))
            x, y = x + at.start, y + mine.start
            yield x, y, scores(anchors.vectors[x], rows.vectors[y])


def _nearest(count: int):
    """The first ``count`` rows of its own label for every anchor, among the rows of a block."""

    def run(rows: _Rows, anchors: _Rows):
        edges = [*np.flatnonzero(np.diff(anchors.labels, prepend=anchors.labels[0] - 1)).tolist(), len(anchors.ids)]
        own = lambda label: slice(*np.searchsorted(rows.labels, [label, label + 1]).tolist())
        meet = [(slice(a, b), own(int(anchors.labels[a]))) for a, b in zip(edges, edges[1:])]
        allowed = lambda x, y: anchors.ids[x] != rows.ids[y]

        def keep(places, least, most):
            if least.shape[1] <= count:
                return np.ones(least.shape, bool)
            sure = np.partition(least, -count, axis=1)[:, -count, None]
            return most >= sure

        for x, y, score in _kept_pairs(rows, anchors, meet, allowed, keep):
            best = _first(x, rows.ids[y], score, count)
            yield [anchors.ids[x[best]], rows.ids[y[best]], score[best]]

    return run


def _floor_of(score: int, share: tuple[int, int]) -> int:
    """The least whole number that is at least that share of ``score``."""
    return max(-(-score * share[0] // share[1]), -_LONG - 1)


def _below(count: int, share: tuple[int, int]):
    """Per anchor and positive the first ``count`` rows of other labels from a share of the positive's score up to it."""

    def run(rows: _Rows, anchors: _Rows, positives: list[list[dict]]):
        bands = [[(p["positive_id"], p["score"], _floor_of(p["score"], share)) for p in own] for own in positives]
        wide = max(map(len, bands))
        # bands that no score is in fill up the shorter lists
        tops = np.array([[b[1] for b in own] + [-_LONG - 1] * (wide - len(own)) for own in bands])
        floors = np.array([[b[2] for b in own] + [_LONG] * (wide - len(own)) for own in bands])
        of = np.array([[b[0] for b in own] + [0] * (wide - len(own)) for own in bands])
        meet = [(slice(0, len(anchors.ids)), slice(0, len(rows.ids)))]
        allowed = lambda x, y: (anchors.labels[x] != rows.labels[y]) & (anchors.ids[x] != rows.ids[y])

        def keep(places, least, most):
            kept = np.zeros(least.shape, bool)
            for k in range(wide):
                kept |= (most >= floors[places, k, None]) & (least <= tops[places, k, None])
            return kept

        for x, y, score in _kept_pairs(rows, anchors, meet, allowed, keep):
            for k in range(wide):
                fits = np.flatnonzero((score >= floors[x, k]) & (score <= tops[x, k]))
                best = fits[_first(x[fits], rows.ids[y[fits]], score[fits], count)]
                yield [anchors.ids[x[best]], of[x[best], k], tops[x[best], k], rows.ids[y[best]], score[best]]

    return run


def _coded(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vector, codes, aligned, rest) of rows (vec_id, label, vector array<double>)."""

    @tidy
    def run(batches):
        for batch in batches:
            lists = batch.column("vector")
            ends = lists.offsets.to_numpy().astype(np.int64)
            flat, dims = lists.values.to_numpy(zero_copy_only=False), np.diff(ends)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                vectors = flat[ends[:-1][at][:, None] + np.arange(d)].reshape(len(at), d)
                words, aligned, rest = encode(vectors)
                raw = lambda x: pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())
                place = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(place), batch.column("label").take(place), raw(vectors), raw(words), raw(aligned), pa.array(rest)],
                    ["vec_id", "label", "vector", "codes", "aligned", "rest"])

    return rows.mapInArrow(run, _CODED)


def _met(rows: DataFrame, anchors: DataFrame, blocks: int, chunks: int, run, schema: str) -> DataFrame:
    """``run`` on every block of rows with every chunk of anchors, each pair of these a group of bounded size."""
    cell = F.struct("block", "chunk")
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("*", dealt(blocks).alias("block"), every(chunks).alias("chunk")).withColumn("cell", cell).drop("block", "chunk")
    # another hash, as the ids of one block of rows would be one chunk of anchors
    own = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(chunks)).cast("int")
    # columns of their own, as anchors are rows too
    anchors = anchors.select([F.col(c).alias(c) for c in anchors.columns])
    right = anchors.select("*", own.alias("chunk"), every(blocks).alias("block")).withColumn("cell", cell).drop("block", "chunk")
    names = [part.split()[0] for part in schema.split(", ")]

    def group(left_table: pa.Table, right_table: pa.Table) -> pa.Table:
        found = []
        if left_table.num_rows and right_table.num_rows:
            mine, theirs = _by_length(left_table), _by_length(right_table)
            for d in mine.keys() & theirs.keys():
                more = [theirs[d].column("positives").to_pylist()] if "positives" in right_table.column_names else []
                found += [pa.table([pa.array(c, pa.int64()) for c in columns], names) for columns in run(_Rows(mine[d], d), _Rows(theirs[d], d), *more)]
        return pa.concat_tables(found) if found else pa.table([pa.array([], pa.int64()) for _ in names], names)

    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(group, schema)


def _ranked(found: DataFrame, keys: list[str], score: str, tie: str, count: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def mine_negatives(rows: DataFrame, anchor: str, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among ``rows``.

    ``rows`` are (vec_id, label, vector array<double> of whole numbers); ``anchor`` is a SQL condition on these columns. The score of
    two rows is the inner product of their vectors, exact as a long; one beyond its range is its end. An anchor's positives are its
    first other rows of the same label by score, then smaller id; its negatives for a positive the first rows of other labels whose
    score is at most the positive's and at least the given share of it.

    A row takes no part whose id, label or vector is null, empty or holds a null or non-finite component. Rows that repeat an id
    count as one, that with the smallest label, then vector. Vectors of different lengths don't meet. Zero vectors and equal vectors are
    like all others. An anchor without positives, and a positive without negatives, give no rows; so does an empty table.
    Other columns are left out.

    Every row meets every anchor, in groups of a block of rows and a chunk of anchors; a group hands on at most ``positives`` rows per
    anchor, or ``negatives`` per anchor and positive, so no label, vector or anchor gathers many rows in a task.
    """
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & finite
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    one_each = rows.filter(F.coalesce(usable, F.lit(False))).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row"))
    marked = one_each.select("vec_id", "row.label", "row.vector").repartition("vec_id")
    coded = cut(_coded(marked))
    asked = coded.filter(anchor)
    sizes = coded.agg(F.count("*").alias("rows"), F.count(F.when(F.expr(anchor), 1)).alias("anchors")).first()
    # as many groups as keep tasks busy, none larger than a task's memory is meant for
    blocks = max(-(-sizes["rows"] // BLOCK_ROWS), min(32, -(-sizes["rows"] // LEAST_ROWS)), 1)
    chunks = max(-(-sizes["anchors"] // BLOCK_ANCHORS), 1)
    near = _met(coded, asked, blocks, chunks, _nearest(positives), "anchor_id long, positive_id long, score long")
    best = cut(_ranked(near, ["anchor_id"], "score", "positive_id", positives).drop("rank"))
    own = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "score")).alias("positives"))
    found = _met(coded, asked.join(own, "vec_id"), blocks, chunks, _below(negatives, share),
                 "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    ranked = _ranked(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
