"""Token log-probabilities from a log-bilinear model trained with noise-contrastive estimation.

Tokens are words (lower case for A-Z, split at ASCII white space) and one end per text. The most frequent
tokens are units of their own; every other word belongs to one of a fixed number of classes by
its ending, and each class is a unit. The neural part predicts a unit from the two before it:

    score(u | a, b) = (left * R[a] + near * R[b]) . Q[u] + bias[u]

and is trained on all training texts: every task starts from the same parameters (fitted on a bounded number
of texts), takes noise-contrastive steps over the texts of its partition, and the parameters are averaged by
tokens. Scores are normalised exactly over all units by batched matrix products. Within a class a word has its
share of the class's tokens. The words seen once stand for the mass of unseen words and for their number, so an unseen word has
as much as a word seen once, and a class's words and as many unseen ones as words seen once, and one more, sum to 1.

The parameters are averaged once, so they depend on how the texts lie in partitions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import Words, cut, hash_strings, in_slices, mix, slices, texts_of, tidy

SHORTLIST, CLASSES, WIDTH = 640, 128, 24
# Words whose counts every task holds; counts of rarer ones are joined.
FREQUENT = 1 << 17
END = "\n"  # no word can be this
NOISE, BATCH = 64, 1024


def _hash(words: list[str]) -> np.ndarray:
    return mix(hash_strings(words))


END_HASH = int(_hash([END]).view(np.int64)[0])


def _classes(words: list[str], hashes: np.ndarray) -> np.ndarray:
    """The class of each word, by its last two characters."""
    return (_hash([w[-2:] for w in words]) % np.uint64(CLASSES)).astype(np.int32)


class Tokens:
    """The tokens of a slice: hashes and classes of the distinct ones, ``codes`` with an end after each text."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        n = len(words.starts) - 1
        self.unique = [*words.unique, END]
        self.hashes = _hash(self.unique)
        self.classes = _classes(self.unique, self.hashes)
        self.starts = words.starts + np.arange(n + 1)
        self.codes = np.full(int(self.starts[-1]), len(words.unique), np.int32)
        at = np.arange(len(words.codes)) + words.doc_of()
        self.codes[at] = words.codes

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def count_tokens(texts: DataFrame) -> DataFrame:
    """(h, class, c): the 64-bit hash, class and count of every distinct token; counted per partition first."""

    @tidy
    def run(batches):
        held = (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64))
        for part in slices(batches):
            tokens = Tokens(part.column("text"))
            counts = np.bincount(tokens.codes, minlength=len(tokens.unique))
            h, kind, c = (np.concatenate(x) for x in zip(held, (tokens.hashes, tokens.classes, counts)))
            h, at, back = np.unique(h, return_index=True, return_inverse=True)
            held = (h, kind[at], np.bincount(back, c).astype(np.int64))
            if len(h) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64)), pa.array(held[1]), pa.array(held[2])], ["h", "class", "c"])
                held = tuple(x[:0] for x in held)
        on = held[2] > 0
        yield pa.RecordBatch.from_arrays([pa.array(held[0][on].view(np.int64)), pa.array(held[1][on]), pa.array(held[2][on])], ["h", "class", "c"])

    rows = texts.mapInArrow(run, "h long, class int, c long").filter("c > 0")
    return rows.groupBy("h").agg(F.min("class").alias("class"), F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Bounded by its parameters: the frequent tokens sorted by hash with their counts, and totals per class."""

    hashes: np.ndarray
    counts: np.ndarray
    units: np.ndarray  # the unit of each frequent token, -1 for its class
    unit_counts: np.ndarray
    class_tokens: np.ndarray  # tokens of each class outside the shortlist
    class_once: np.ndarray  # of those, words seen once
    total: int
    distinct: int

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which are frequent, and their place."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] == hashes, at

    def units_of(self, tokens: Tokens) -> np.ndarray:
        known, at = self.find(tokens.hashes)
        own = np.where(known, self.units[at] if len(self.units) else -1, -1)
        return np.where(own >= 0, own, SHORTLIST + tokens.classes).astype(np.int32)


def vocabulary(counts: DataFrame, frequent: int = FREQUENT) -> Vocabulary:
    """At most ``frequent`` words reach the driver: those over the lowest count step that lets no more through."""
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    # counts in steps of a few percent, so that the words over a threshold can be counted first
    step = F.floor(F.log2("c") * 32).cast("int")
    steps = sorted(counts.groupBy(step.alias("s")).count().collect(), reverse=True)
    room, least = frequent, 1 << 30
    for s, n in steps:
        if n > room:
            break
        room, least = room - n, s
    top = counts.filter(step >= least).toPandas().sort_values(["c", "h"], ascending=[False, True], ignore_index=True)
    short = top.head(SHORTLIST)
    own = counts.filter(~F.col("h").isin([int(x) for x in short["h"]])) if len(short) else counts
    kinds = own.groupBy("class").agg(F.sum("c").alias("n"), F.sum((F.col("c") == 1).cast("long")).alias("once")).toPandas()
    class_tokens, class_once = np.zeros(CLASSES), np.zeros(CLASSES)
    class_tokens[kinds["class"].to_numpy(int)], class_once[kinds["class"].to_numpy(int)] = kinds["n"], kinds["once"]
    units = np.full(len(top), -1, np.int32)
    units[: len(short)] = np.arange(len(short))
    hashes = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    unit_counts = np.concatenate([short["c"].to_numpy(float), np.zeros(SHORTLIST - len(short)), class_tokens])
    return Vocabulary(hashes[order], top["c"].to_numpy(np.int64)[order], units[order], unit_counts, class_tokens, class_once,
                      int(totals["n"] or 0), int(totals["v"]))


class LogBilinear:
    """Parameters of the unit model; ``values`` (units, 2 * WIDTH + 1) holds R, Q and the bias, ``place`` the two position weights."""

    def __init__(self, unit_counts: np.ndarray, seed: int = 5):
        draw = np.random.default_rng(seed)
        units = len(unit_counts)
        self.noise = (unit_counts + 0.5) / (unit_counts + 0.5).sum()
        self.R = draw.normal(0, 0.1, (units, WIDTH)).astype(np.float32)
        self.Q = draw.normal(0, 0.1, (units, WIDTH)).astype(np.float32)
        self.bias = np.log(self.noise).astype(np.float32)
        self.place = np.ones((2, WIDTH), np.float32)

    def hidden(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.R[a] * self.place[0] + self.R[b] * self.place[1]

    def log_normaliser(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Log of the sum over all units, by matrix products of bounded size."""
        out = np.empty(len(a), np.float32)
        for k in range(0, len(a), 4096):
            logits = self.hidden(a[k : k + 4096], b[k : k + 4096]) @ self.Q.T + self.bias
            top = logits.max(1, keepdims=True)
            out[k : k + 4096] = (np.log(np.exp(logits - top).sum(1, keepdims=True)) + top)[:, 0]
        return out

    def pack(self) -> np.ndarray:
        extra = np.zeros((2, 2 * WIDTH + 1))
        extra[:, :WIDTH] = self.place
        return np.concatenate([np.concatenate([self.R, self.Q, self.bias[:, None]], 1), extra]).astype(np.float64)

    def unpack(self, values: np.ndarray) -> LogBilinear:
        values = values.astype(np.float32)
        self.R, self.Q, self.bias, self.place = values[:-2, :WIDTH].copy(), values[:-2, WIDTH:-1].copy(), values[:-2, -1].copy(), values[-2:, :WIDTH].copy()
        return self


def _gather(rows: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the gradients of equal rows."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    return rows[starts], np.add.reduceat(grads[order], starts, axis=0)


class Trainer:
    """Noise-contrastive steps with AdaGrad; the noise of a batch is shared by its tokens."""

    def __init__(self, model: LogBilinear, rate: float = 0.1, seed: int = 11):
        self.m, self.rate = model, rate
        self.draw = np.random.default_rng(seed)
        self.squares = {k: np.full(getattr(model, k).shape, 0.1, np.float32) for k in ("R", "Q", "bias", "place")}
        self.steps = np.cumsum(model.noise)
        self.log_noise = np.log(model.noise * NOISE).astype(np.float32)

    def _step(self, name: str, rows, grad: np.ndarray) -> None:
        square = self.squares[name]
        square[rows] += grad * grad
        getattr(self.m, name)[rows] -= self.rate * grad / np.sqrt(square[rows])

    def learn(self, a: np.ndarray, b: np.ndarray, u: np.ndarray) -> None:
        order = self.draw.permutation(len(u))
        for k in range(0, len(u), BATCH):
            at = order[k : k + BATCH]
            self._batch(a[at], b[at], u[at])

    def _batch(self, a: np.ndarray, b: np.ndarray, u: np.ndarray) -> None:
        m, n = self.m, len(u)
        noise = np.minimum(np.searchsorted(self.steps, self.draw.random(NOISE) * self.steps[-1]), len(self.steps) - 1)
        ra, rb, q = m.R[a], m.R[b], m.Q[u]
        h = ra * m.place[0] + rb * m.place[1]
        own = (h * q).sum(1) + m.bias[u] - self.log_noise[u]
        qn = m.Q[noise]
        other = h @ qn.T + (m.bias[noise] - self.log_noise[noise])
        g_own = -1 / (1 + np.exp(np.clip(own, -30, 30)))
        g_other = 1 / (1 + np.exp(-np.clip(other, -30, 30)))
        gh = g_own[:, None] * q + g_other @ qn
        grad_q = np.concatenate([g_own[:, None] * h, g_other.T @ h])
        grad_b = np.concatenate([g_own, g_other.sum(0)])
        rows, both = _gather(np.concatenate([u, noise]), np.concatenate([grad_q, grad_b[:, None]], 1))
        both /= math.sqrt(n)
        self._step("Q", rows, both[:, :-1])
        self._step("bias", rows, both[:, -1])
        rows, grad = _gather(np.concatenate([a, b]), np.concatenate([gh * m.place[0], gh * m.place[1]]))
        self._step("R", rows, grad / math.sqrt(n))
        self._step("place", slice(None), np.stack([(gh * ra).sum(0), (gh * rb).sum(0)]) / n)


def _contexts(units: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The two units before each token; ends stand before a text."""
    near, left = np.roll(units, 1), np.roll(units, 2)
    first = starts[:-1][np.diff(starts) > 0]
    near[first] = end
    left[first] = end
    second = first[first + 1 < len(units)] + 1
    left[second] = end
    return left, near


def _end_unit(words: Vocabulary) -> int:
    known, at = words.find(np.array([END_HASH], np.int64).view(np.uint64))
    return int(words.units[at[0]]) if known[0] and words.units[at[0]] >= 0 else SHORTLIST + int(_classes([END], np.zeros(1))[0])


def train(texts: DataFrame, words: Vocabulary, first_texts: int = 400, longest: int = 10_000) -> LogBilinear:
    """One pass of averaged training over all of ``texts`` (doc_id, text).

    The common start is fitted on the driver from at most ``first_texts`` texts of at most ``longest`` characters.
    """
    model, end = LogBilinear(words.unit_counts), _end_unit(words)
    few = texts.filter(F.length("text") <= longest).orderBy(F.xxhash64("doc_id", F.lit(3)), "text").limit(first_texts).toPandas()
    if not len(few):
        return model
    start = Tokens(pa.array(few["text"].tolist(), pa.string()))
    units = words.units_of(start)[start.codes]
    teach = Trainer(model)
    for _ in range(3):
        teach.learn(*_contexts(units, start.starts, end), units)
    base = model.pack()

    @tidy
    def run(batches):
        own = LogBilinear(words.unit_counts).unpack(base)
        trainer, seen = Trainer(own, rate=0.05), 0
        for part in slices(batches):
            tokens = Tokens(part.column("text"))
            units = words.units_of(tokens)[tokens.codes]
            trainer.learn(*_contexts(units, tokens.starts, end), units)
            seen += len(units)
        if seen:
            values = own.pack() * seen
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(values))), pa.array(np.full(len(values), float(seen))), pa.array(list(values), pa.list_(pa.float64()))],
                ["unit", "seen", "v"])

    parts = texts.mapInArrow(run, "unit long, seen double, v array<double>")
    mean = [(F.sum(F.col("v")[i]) / F.sum("seen")).alias(f"v{i}") for i in range(2 * WIDTH + 1)]
    rows = parts.groupBy("unit").agg(*mean).toPandas().sort_values("unit")
    return model.unpack(rows.drop(columns="unit").to_numpy()) if len(rows) else model


def score_texts(docs: DataFrame, counts: DataFrame, words: Vocabulary, model: LogBilinear) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for every row of ``docs`` (doc_id, text).

    ``counts`` is the table of ``count_tokens``. ``base_score`` is the sum of log10((c + 1) / (N + V + 1)) over the
    tokens, ``score`` the model's log10 probability of the text. A missing or empty text is its end token alone. Rows are
    scored one by one: repeated rows repeat, a null id stays null; other columns are ignored.
    """
    n_types = float(words.total + words.distinct + 1)
    end = _end_unit(words)
    # the share of a class that goes to each of its tokens, per count; an unseen word counts as one
    room = words.class_tokens + words.class_once + 1.0
    unseen = -np.log10(room)

    def make():
        units_n = len(words.unit_counts)
        known_z = np.full(units_n * units_n, np.nan, np.float32)
        row = TaskContext.get().partitionId() << 36

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal row
            tokens = Tokens(part.column("text"))
            units, doc, n = words.units_of(tokens)[tokens.codes], tokens.doc_of(), part.num_rows
            a, b = _contexts(units, tokens.starts, end)
            pair = a.astype(np.int64) * units_n + b
            missing = np.unique(pair[np.isnan(known_z[pair])])
            known_z[missing] = model.log_normaliser(missing // units_n, missing % units_n)
            logp = np.empty(len(units), np.float64)
            for k in range(0, len(units), 1 << 17):
                s = slice(k, k + (1 << 17))
                logp[s] = (model.hidden(a[s], b[s]) * model.Q[units[s]]).sum(1) + model.bias[units[s]] - known_z[pair[s]]
            logp /= math.log(10)
            frequent, at = words.find(tokens.hashes)
            c = np.where(frequent, words.counts[at] if len(words.counts) else 0, 0)
            base = np.log10((c + 1.0) / n_types)
            alone = words.units_of(tokens) < SHORTLIST
            inside = np.where(alone | ~frequent, 0.0, np.log10(np.maximum(c, 1) / room[tokens.classes]))
            code, on = tokens.codes, frequent[tokens.codes]
            sums = lambda x: np.bincount(doc, x, n)
            summary = {
                "row": row + np.arange(n), "doc_id": part.column("doc_id"), "h": mix((row + np.arange(n)).astype(np.uint64)).view(np.int64),
                "times": np.zeros(n, np.int64), "class": np.zeros(n, np.int32), "n_tokens": np.diff(tokens.starts), "n_known": sums(on).astype(np.int64),
                "base": sums(np.where(on, base[code], 0.0)), "model": sums(logp + inside[code]),
            }
            rare = np.flatnonzero(~on)
            keys, times = np.unique(doc[rare].astype(np.int64) << np.int64(32) | code[rare], return_counts=True)
            who, what = keys >> 32, keys & 0xFFFFFFFF
            zero = np.zeros(len(keys))
            tail = {
                "row": row + who, "doc_id": part.column("doc_id").take(pa.array(who)), "h": tokens.hashes[what].view(np.int64), "times": times.astype(np.int64),
                "class": tokens.classes[what], "n_tokens": zero.astype(np.int64), "n_known": zero.astype(np.int64), "base": zero, "model": zero,
            }
            row += n
            join = lambda x, y: pa.concat_arrays([z if isinstance(z, pa.Array) else pa.array(z) for z in (x, y)])
            return pa.RecordBatch.from_arrays([join(summary[k], tail[k]) for k in summary], list(summary))

        return one

    kind = "row long, doc_id long, h long, times long, class int, n_tokens long, n_known long, base double, model double"
    parts = in_slices(texts_of(docs), make, kind)
    if words.distinct > len(words.hashes):
        found = parts.join(counts.select("h", "c"), "h", "left").withColumn("c", F.when(F.col("times") > 0, F.col("c")))
    else:
        found = parts.withColumn("c", F.lit(None).cast("long"))
    pick = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("class"))
    inside = F.when(F.col("c").isNotNull(), F.log10("c") - pick(np.log10(room))).otherwise(pick(unseen))
    return found.groupBy("row", "doc_id").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(n_types))).alias("base_score"),
        F.sum(F.col("model") + F.when(F.col("times") > 0, F.col("times") * inside).otherwise(0.0)).alias("score"),
    ).drop("row")


def fit_and_score(docs: DataFrame, learn_from: DataFrame) -> tuple[DataFrame, int]:
    """Scores of ``docs`` under a model of ``learn_from``, and the number of training tokens. An empty
    training table gives the model of one unseen token per class."""
    texts = texts_of(learn_from)
    counts = cut(count_tokens(texts))
    words = vocabulary(counts)
    return score_texts(docs, counts, words, train(texts, words)), words.total
