"""Near copies by BagMinHash: signatures of shingle multisets, bands, exact verification, classes.

A text is the multiset of its runs of five words (lower case for A-Z, split at ASCII white space);
fewer words make one shingle. Likeness is the weighted Jaccard index of two multisets, the sum
of the smaller counts over the sum of the larger ones.

Each shingle owns Poisson processes over its weight axis, one per dyadic range [0,1), [1,2), [2,4), ...
A point has a time, a signature component and, by further halving of its range, a weight level; a text
sees the points below the shingle's count. The first point per component is the signature, so two
components agree with the probability of the weighted Jaccard index. Only points up to the time at
which all components are filled are generated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.components import classes_of
from tickloom.llm.shared import Words, cut, cut_small, in_slices, mix, slices, texts_of, tidy

SHINGLE = 5
LIKENESS = 0.8
BANDS, ROWS = 32, 6
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def bags(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, shingle hash, count) of every distinct shingle of every text, ordered by doc and hash."""
    words = Words(texts)
    if not len(words.codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = mix(words.hashes())[words.codes]
    doc = words.doc_of()
    rolled = np.zeros(len(h), np.uint64)
    for k in range(min(size, len(h))):  # the one shingle of a text with fewer words is shorter
        ahead = np.zeros(len(h), np.uint64)
        ahead[: len(h) - k] = h[k:]
        same = np.zeros(len(h), bool)
        same[: len(h) - k] = doc[k:] == doc[: len(h) - k]
        rolled = np.where(same, mix(rolled * _STEP + ahead), rolled)
    place = np.arange(len(h)) - words.starts[doc]
    first = place <= np.maximum(words.lengths[doc] - size, 0)
    doc, rolled = doc[first], rolled[first]
    order = np.lexsort((rolled, doc))
    doc, rolled = doc[order], rolled[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (rolled[1:] != rolled[:-1])
    at = np.flatnonzero(new)
    return doc[at], rolled[at], np.diff(np.append(at, len(doc)))


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """(n_docs, m) unsigned: the first point of each component; all ones for a text without shingles."""
    out = np.full((n_docs, m), _NONE, np.uint64)
    weight = np.bincount(doc, count, n_docs)
    # one process per shingle and dyadic range below its count; range j has length max(1, 2^(j-1))
    ranges = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1
    who = np.repeat(np.arange(len(doc)), ranges)
    level = np.arange(len(who)) - np.repeat(np.cumsum(ranges) - ranges, ranges)
    span = np.where(level > 0, 1 << np.maximum(level - 1, 0), 1).astype(np.int64)
    own_doc, top = doc[who], count[who]
    with np.errstate(over="ignore"):
        seed = mix(shingle[who] + level.astype(np.uint64) * _STEP)
    rate = (m * span).astype(np.float64)
    until = np.zeros(n_docs)
    until[weight > 0] = (np.log(m) + 2.0) / weight[weight > 0]
    todo = weight > 0
    while todo.any():
        live = np.flatnonzero(todo[own_doc])
        time, state = np.zeros(len(live)), seed[live].copy()
        flat = np.full(n_docs * m, _NONE, np.uint64)
        while len(live):
            with np.errstate(over="ignore"):
                state += _STEP
                draw = mix(state)
                other = mix(draw + _STEP)
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[live]
            on = time <= until[own_doc[live]]
            live, time, state, other = live[on], time[on], state[on], other[on]
            low = (other & np.uint64(0xFFFFFFFF)).astype(np.int64)
            at = np.where(level[live] > 0, span[live], 0) + (((other >> np.uint64(32)).astype(np.int64) * span[live]) >> 32)
            seen = at < top[live]
            place = own_doc[live[seen]] * m + low[seen] % m
            packed = (time[seen].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (mix(other[seen]) >> np.uint64(32))
            np.minimum.at(flat, place, packed)
        flat = flat.reshape(n_docs, m)
        done = todo & (flat != _NONE).all(1)
        out[done] = flat[done]
        todo &= ~done
        until[todo] *= 2
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.zeros((len(signature), bands), np.uint64)
    parts = signature.reshape(len(signature), bands, rows)
    with np.errstate(over="ignore"):
        key += np.arange(1, bands + 1, dtype=np.uint64) * _STEP
        for k in range(rows):
            key = mix(key * _STEP + parts[:, :, k])
    return key.view(np.int64)


def _list_column(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values))


def digest_of(text: str = "text"):
    """The digest of a text; a missing one counts as empty."""
    return F.unhex(F.sha1(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def sketch(texts: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, digest, size, bands): per text its digest, its number of shingles and its band keys (none if empty)."""

    def make():
        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            n = part.num_rows
            doc, shingle, count = bags(part.column("text"))
            size = np.bincount(doc, count, n).astype(np.int64)
            keys = band_keys(signatures(doc, shingle, count, n, bands * rows), bands, rows)[size > 0]
            starts = np.concatenate(([0], np.cumsum(np.where(size > 0, bands, 0))))
            return pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("digest"), pa.array(size), _list_column(keys.ravel(), starts)],
                ["doc_id", "digest", "size", "bands"])

        return one

    return in_slices(texts.withColumn("digest", digest_of()), make, "doc_id long, digest binary, size long, bands array<long>")


class Sieve:
    """Lets through all ids it was made of and few others: a table of bits whose size has a bound.

    It saves moving texts that nobody asked for; what passes it is still joined with the ids.
    """

    def __init__(self, ids: DataFrame, column: str, most_bits: int = 1 << 28):
        n = ids.count()
        self.bits = min(most_bits, 1 << max(10, (16 * n).bit_length()))
        places = ids.select(self.place(F.col(column)).alias("p")).selectExpr("p div 64 AS word", "shiftleft(1L, cast(p % 64 AS int)) AS bit")
        found = places.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
        table = np.zeros(self.bits // 64, np.int64)
        table[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
        self.table = table

    def place(self, column):
        return F.pmod(F.xxhash64(column), F.lit(self.bits))

    def passes(self, places: np.ndarray) -> np.ndarray:
        return (self.table[places // 64] >> (places % 64)) & 1 == 1


def bag_table(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, bag, short) of the texts in ``wanted`` (rep, first, digest), ``doc_id`` being ``rep``: sorted 64-bit hashes, one per shingle
    and occurrence, and their short form.

    A text is found by its digest in the rows with the id ``first``.
    The n-th occurrence of a shingle has a hash of its own, so that bags are sets.
    """
    sieve = Sieve(wanted.select(F.xxhash64("first", "digest").alias("both")), "both")
    rows = texts.withColumn("digest", digest_of()).select(
        F.col("doc_id").alias("first"), "digest", "text", sieve.place(F.xxhash64("doc_id", "digest")).alias("place"))

    @tidy
    def run(batches):
        for batch in batches:
            some = batch.filter(pa.array(sieve.passes(batch.column("place").to_numpy())))
            for part in slices(iter([some])):
                doc, shingle, count = bags(part.column("text"))
                who = np.repeat(np.arange(len(doc)), count)
                nth = (np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
                with np.errstate(over="ignore"):
                    each = np.where(nth > 0, mix(shingle[who] + nth * _STEP), shingle[who])
                at = np.searchsorted(doc[who], np.arange(part.num_rows + 1))
                bag = [np.sort(each[a:b]) for a, b in zip(at[:-1], at[1:])]
                raw = lambda rows: pa.array([x.tobytes() for x in rows], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("first"), part.column("digest"), raw(bag), raw([shortened(x) for x in bag])], ["first", "digest", "bag", "short"])

    made = rows.mapInArrow(run, "first long, digest binary, bag binary, short binary").dropDuplicates(["first", "digest"])
    return made.join(wanted, ["first", "digest"]).select(F.col("rep").alias("doc_id"), "bag", "short")


def shortened(bag: np.ndarray) -> np.ndarray:
    """The first 16 bits of each hash of a bag, in order: two bags share at most as many hashes as they share of these."""
    return (bag >> np.uint64(48)).astype(np.uint16)


def bound(a: np.ndarray, b: np.ndarray) -> float:
    """At least the likeness of the bags that ``a`` and ``b`` are the short forms of."""
    return likeness(*[x.astype(np.uint64) << np.uint64(32) | (np.arange(len(x)) - np.searchsorted(x, x)).astype(np.uint64) for x in (a, b)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two bags, which is the weighted one of the multisets."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / max(len(a) + len(b) - shared, 1)


# A text that is compared with very many others meets them in so many tasks.
PARTS = 128
# Texts with the same rare hash that meet in one task.
CROWD = 512


def _judged(pairs: DataFrame, values: DataFrame, judge, kind) -> DataFrame:
    """(a, b, like) of all ``pairs`` (a, b), ``judge`` of their ``values`` (doc_id, value): each group's b comes first, then all its a."""
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(PARTS)).alias("part"))
    left = dealt.join(values.withColumnRenamed("doc_id", "a"), "a").select("b", "part", "a", "value")
    right = dealt.select("b", "part").distinct().join(values.withColumnRenamed("doc_id", "b"), "b").select(
        "b", "part", F.lit(None).cast("long").alias("a"), "value")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = left.union(right).repartition(parts, "b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

    @tidy
    def run(batches):
        head = np.zeros(0, kind)
        for batch in batches:
            like = np.zeros(batch.num_rows)
            for i, (a, value) in enumerate(zip(batch.column("a").to_pylist(), batch.column("value"))):
                if a is None:
                    head = np.frombuffer(value.as_py(), kind)
                else:
                    like[i] = judge(np.frombuffer(value.as_py(), kind), head)
            whole = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(like)], ["a", "b", "like"])
            yield whole.filter(batch.column("a").is_valid())

    return rows.mapInArrow(run, "a long, b long, like double")


def compare(pairs: DataFrame, bags_of: DataFrame, least: float = LIKENESS) -> DataFrame:
    """(a, b) of the ``pairs`` whose likeness is at least that.

    Short forms, a quarter of the bags, meet first and rule out nearly all pairs that are unlike, surely; the others meet by their whole bags.
    """
    short = _judged(pairs, bags_of.select("doc_id", F.col("short").alias("value")), bound, np.uint16)
    left = cut_small(short.filter(F.col("like") >= least - 1e-9).select("a", "b"))
    exact = _judged(left, bags_of.select("doc_id", F.col("bag").alias("value")), likeness, np.uint64)
    return exact.filter(F.col("like") >= least).select("a", "b")


def near_copies(docs: DataFrame, likeness_at_least: float = LIKENESS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, kept): the class of near copies of every row of ``docs`` (doc_id, text).

    Texts of equal bytes are one class at once (so are all empty or missing texts). Different texts
    that share a band are linked if their likeness is ``likeness_at_least`` or more: every text of
    a band's bucket is compared with the smallest id of most of its buckets, then, where these are of another class, with its neighbours
    when a bucket is ordered by the texts' next bands; where a bucket's texts are then still in different classes, they
    are compared with all texts of other classes that an exact prefix filter on rare shingles leaves possible. Classes are the connected
    components; ``class_id`` is the smallest id of the class and ``kept`` marks that row. Rows that repeat
    an id and its text share a class; rows that repeat an id with another text are texts by themselves, and where several
    texts of a class have its smallest id, one of them is kept. Rows without an id are compared with nothing and kept (class
    null). Other columns are ignored; an empty table gives no rows.
    """
    return classes_of_texts(docs, likeness_at_least, bands, rows).drop("digest")


def classes_of_texts(docs: DataFrame, likeness_at_least: float = LIKENESS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, digest, class_id, kept): ``near_copies`` with the digest of every row's text."""
    texts = texts_of(docs)
    sketches = cut(sketch(texts, bands, rows))
    held = sketches.filter("doc_id IS NOT NULL")
    # a number per text, since texts may share their smallest id
    firsts = cut_small(held.groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("size").alias("size"), F.first("bands").alias("bands"))
                 .withColumn("rep", F.monotonically_increasing_id()))
    crowd = firsts.filter("size > 0").select("rep", F.explode("bands").alias("key")).groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("n"))
    crowd = cut_small(crowd.filter("n > 1").drop("n"))
    members = cut_small(_members(firsts.filter("size > 0"), crowd).join(crowd, "key"))
    wanted = cut_small(firsts.select("rep", "first", "digest").join(members.select("rep").distinct(), "rep", "left_semi"))
    packed = cut_small(bag_table(texts, wanted))
    # the head of most of a text's buckets first: it settles most of a crowd of near copies with one pair a text
    first = members.filter("rep <> head").groupBy("rep").agg(F.mode("head", True).alias("head")).toDF("a", "b")
    compared, found = None, None
    for make in (lambda: first, lambda: _neighbours(members, found, likeness_at_least), lambda: _missed(members, found, packed, likeness_at_least)):
        pairs = make()
        pairs = cut_small(pairs if compared is None else pairs.join(compared, ["a", "b"], "left_anti"))
        compared = pairs if compared is None else compared.union(pairs)
        if found is not None and not pairs.take(1):
            continue
        links = compare(pairs, packed, likeness_at_least)
        if found is not None:
            links = links.union(found.select(F.col("node").alias("a"), F.col("class_id").alias("b")))
        found = cut_small(classes_of(links))
    linked = found.select(F.col("node").alias("rep"), F.col("class_id").alias("root")).join(firsts.select("rep", "first", "digest"), "rep")
    least = linked.groupBy("root").agg(F.min(F.struct("first", "digest")).alias("least"))
    named = firsts.select("digest", "rep", "first").join(linked.join(least, "root").select("rep", "least"), "rep", "left")
    named = cut_small(named.select("digest", F.coalesce("least", F.struct("first", "digest")).alias("least")))
    out = held.select("doc_id", "digest").join(named, "digest").select("doc_id", "digest", F.col("least.first").alias("class_id"), (
        (F.col("doc_id") == F.col("least.first")) & (F.col("digest") == F.col("least.digest"))).alias("kept"))
    lone = sketches.filter("doc_id IS NULL").select("doc_id", "digest", F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))
    return out.union(lone)


def _members(firsts: DataFrame, crowd: DataFrame) -> DataFrame:
    """(key, rep, size, beside): a row per text of ``firsts`` and band whose key may be in ``crowd``, with the key of its next band."""
    sieve = Sieve(crowd.select("key"), "key")

    @tidy
    def run(batches):
        for batch in batches:
            keys = np.stack(batch.column("bands").to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, 1), np.int64)
            places = np.stack(batch.column("places").to_numpy(zero_copy_only=False)) if batch.num_rows else keys
            row, band = np.nonzero(sieve.passes(places))
            beside = keys[row, (band + 1) % keys.shape[1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[row, band]), batch.column("rep").take(pa.array(row)), batch.column("size").take(pa.array(row)), pa.array(beside)],
                ["key", "rep", "size", "beside"])

    placed = firsts.select("rep", "size", "bands", F.transform("bands", sieve.place).alias("places"))
    return placed.mapInArrow(run, "key long, rep long, size long, beside long")


def _alike_in_size(a, b, least: float):
    """Whether the sizes ``a`` and ``b`` leave the wanted likeness possible."""
    return F.least(a, b) >= least * F.greatest(a, b) - 1e-6


def _classed(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` with the class that each text has come to so far."""
    named = found.select(F.col("node").alias("rep"), "class_id")
    return members.join(named, "rep", "left").withColumn("class", F.coalesce("class_id", "rep")).drop("class_id")


def _neighbours(members: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b), each once, of different classes: texts at most three apart when a bucket is ordered by the texts' next band."""
    # a bucket is cut into 256 runs of that order, so that none is one window
    order = W.partitionBy("key", F.shiftright("beside", 56)).orderBy("beside", "rep")
    before = F.array(*[F.lag(F.struct("rep", "class", "size"), k).over(order) for k in (1, 2, 3)])
    other = lambda x: (x["class"] != F.col("class")) & _alike_in_size(F.col("size"), x["size"], least)
    near = _classed(members, found).withColumn("before", before).withColumn("before", F.explode(F.filter("before", other)))
    return near.selectExpr("greatest(rep, before.rep) AS a", "least(rep, before.rep) AS b").distinct()


def _missed(members: DataFrame, found: DataFrame, packed: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) that heads and neighbours have not settled.

    They are of texts that share some bucket with a text of another class, whatever their distance to its head. Which of
    these texts may be linked is told by an exact prefix filter: two bags of the wanted likeness share one of their
    rarest hashes, of each the share that may differ and one more, and have enough hashes behind it.
    """
    classed = _classed(members.select("key", "rep", "size"), found).withColumnRenamed("rep", "doc_id")
    mixed = classed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high").select("key")
    open_ = cut_small(classed.join(mixed, "key", "left_semi").select("doc_id", "class", "size").distinct())

    def hashes(batches):
        for part in slices(batches, "bag"):
            bag = [np.frombuffer(b.as_py(), np.int64) for b in part.column("bag")]
            size = np.array([len(b) for b in bag], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(part.column("doc_id").to_numpy(), size)), pa.array(np.repeat(part.column("class").to_numpy(), size)),
                 pa.array(np.concatenate(bag))], ["doc_id", "class", "hash"])

    held = packed.select("doc_id", "bag").join(open_, "doc_id").mapInArrow(tidy(hashes), "doc_id long, class long, hash long")
    seen = held.groupBy("hash").agg(F.count("*").alias("n"), (F.min("class") != F.max("class")).alias("mixed"))
    order = W.partitionBy("doc_id").orderBy("n", "hash")
    first = held.select("doc_id", "hash").join(seen, "hash").withColumn("at", F.row_number().over(order)).filter("mixed").join(open_, "doc_id")
    first = first.filter(F.col("at") <= F.col("size") - F.ceil(F.col("size") * least - 1e-6) + 1)
    first = cut_small(first.withColumn("parts", F.ceil(F.col("n") / CROWD)).select("doc_id", "class", "size", "hash", "at", "parts"))
    # a hash of many texts is many tasks: each text stands in one part of it, and meets all parts
    part = first.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).drop("parts")
    other = first.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    other = other.toDF("other", "other_class", "other_size", "hash", "other_at", "part")
    # behind the first shared hash there must be enough left in both
    most = 1 + F.least(F.col("size") - F.col("at"), F.col("other_size") - F.col("other_at"))
    enough = most * (1 + least) >= (F.col("size") + F.col("other_size")) * least - 1e-6
    met = part.join(other, ["hash", "part"]).filter((F.col("doc_id") > F.col("other")) & (F.col("class") != F.col("other_class")) & enough
                                                   & _alike_in_size(F.col("size"), F.col("other_size"), least))
    return met.select(F.col("doc_id").alias("a"), F.col("other").alias("b")).distinct()
