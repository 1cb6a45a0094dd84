"""Toxic spans and document scores from a linear-chain conditional random field.

Only documents carry labels, so token labels are derived first: a word, or a word's beginning,
is offending if the distinct contexts it stands in lie in toxic documents far more often than
chance allows (a binomial tail bound, corrected for the number of candidates). Counting distinct
contexts keeps copies and shared passages from counting twice. A two-state chain is then trained
on those tokens; its forward-backward marginals give spans and, through a logistic curve,
the score of a document.

The training sample is bounded: ``sample`` documents per label with at most ``longest``
characters each, chosen by a hash of the id. Scoring covers every word of every text.
"""

from __future__ import annotations

import heapq
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import Words, in_slices, mix, slices, tidy

_CORE = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
_WORD = re.compile(r"[^ \t-\r]+")
PREFIXES = (4, 5, 6)


def features(word: str) -> list[str]:
    """The word without what surrounds it, and its beginnings."""
    found = _CORE.search(word)
    if not found:
        return []
    core = found[0]
    return [core, *(f"{core[:n]}-" for n in PREFIXES if len(core) >= n)]


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    start: float = 0.0
    # log potentials of other->toxic, toxic->other and toxic->toxic against other->other
    moves: tuple[float, float, float] = (0.0, 0.0, 0.0)
    curve: tuple[float, float, float] = (-3.0, 2.0, 2.0)

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word))


def _lanes(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word positions dealt to lanes of whole texts, as a matrix (steps, lanes), -1 where a lane is over;
    and which of them begin a text."""
    lengths = np.diff(starts)
    used = np.flatnonzero(lengths)
    if not len(used):
        return np.zeros((0, 1), np.int64), np.zeros((0, 1), bool)
    total, longest = int(lengths.sum()), int(lengths.max())
    lanes = [(0, k) for k in range(min(len(used), max(1, total // max(longest, 1)), 512))]
    place = {}
    for i in used[np.argsort(-lengths[used], kind="stable")]:
        n, k = heapq.heappop(lanes)
        place[i] = (n, k)
        heapq.heappush(lanes, (n + int(lengths[i]), k))
    where = np.full((max(n for n, _ in lanes), len(lanes)), -1, np.int64)
    fresh = np.zeros(where.shape, bool)
    for i, (n, k) in place.items():
        where[n : n + lengths[i], k] = np.arange(starts[i], starts[i + 1])
        fresh[n, k] = True
    return where, fresh


def marginals(score: np.ndarray, starts: np.ndarray, start: float, moves: tuple[float, float, float],
              lanes=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word the log odds of state 1 given the whole text, and the forward and backward ratios."""
    where, fresh = _lanes(starts) if lanes is None else lanes
    up, down, stay = (math.exp(m) for m in moves)
    e = np.exp(np.clip(score, -30, 30))[where] if len(where) else np.zeros(where.shape)
    first = math.exp(start)
    forward, backward = np.empty_like(e), np.empty_like(e)
    r = np.zeros(where.shape[1])
    for t in range(len(e)):
        r = np.where(fresh[t], first, (up + stay * r) / (1.0 + down * r)) * e[t]
        forward[t] = r
    b = np.ones(where.shape[1])
    for t in range(len(e) - 1, -1, -1):
        backward[t] = b
        x = e[t] * b
        b = np.where(fresh[t] | (where[t] < 0), 1.0, (down + stay * x) / (1.0 + up * x))
    live = where >= 0
    out, ahead, behind = (np.zeros(len(score)) for _ in range(3))
    out[where[live]] = np.log(forward[live]) + np.log(backward[live])
    ahead[where[live]], behind[where[live]] = forward[live], backward[live]
    return out, ahead, behind


def _offending(words: Words, toxic: np.ndarray, per_word: list[list[str]]) -> set[str]:
    """Features whose contexts are toxic beyond chance."""
    codes = words.codes.astype(np.int64)
    if not len(codes):
        return set()
    doc = words.doc_of()
    inside = lambda shift: np.where(np.roll(doc, shift) == doc, np.roll(codes, shift), -1)
    around = mix((codes.astype(np.uint64) << np.uint64(32)) + inside(1).astype(np.uint64))
    around = mix(around + inside(-1).astype(np.uint64) * np.uint64(2) + toxic[doc].astype(np.uint64))
    _, one_each = np.unique(around, return_index=True)
    totals = np.stack([np.bincount(codes[one_each][toxic[doc[one_each]] == k], minlength=len(per_word)) for k in (0, 1)], 1).astype(float)
    index: dict[str, int] = {}
    what = np.array([index.setdefault(f, len(index)) for own in per_word for f in own], np.int64)
    who = np.repeat(np.arange(len(per_word)), [len(own) for own in per_word])
    counts = np.stack([np.bincount(what, totals[who, k], len(index)) for k in (0, 1)], 1)
    share = totals[:, 1].sum() / max(totals.sum(), 1)
    if not 0 < share < 1:
        return set()
    often = counts[:, 1] >= 3
    bound = math.log(often.sum() + 1) + 5
    seen = counts.sum(1)
    p = counts[:, 1] / np.maximum(seen, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = p * np.log(p / share) + np.where(p < 1, (1 - p) * np.log((1 - p) / (1 - share)), 0.0)
    beyond = often & (p >= 0.8) & (p > share) & (seen * kl > bound)
    return {f for f, i in index.items() if beyond[i]}


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 1e-2) -> np.ndarray:
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-6) * np.eye(len(w)), grad)
    return w


# Words below these log odds are background, of which a long text has more.
_FLOOR = -4.0


def _summary(odds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per text: the log odds that some word is toxic, and the expected number of toxic words (log), without the background."""
    over = odds > _FLOOR
    p = np.where(over, 1 / (1 + np.exp(-odds)), 0.0)
    some = np.concatenate(([0.0], np.cumsum(np.where(over, np.logaddexp(0, odds), 0.0))))
    any_log = some[starts[1:]] - some[starts[:-1]]
    total = np.concatenate(([0.0], np.cumsum(p)))
    sums = np.maximum(total[starts[1:]] - total[starts[:-1]], 0)
    odds_any = np.log(np.expm1(np.minimum(np.maximum(any_log, 1e-9), 30)))
    return np.stack([np.clip(odds_any, -8, 8) / 8, np.log1p(sums)], 1)


def fit(texts: list[str], toxic: list[int], share: float | None = None, rounds: int = 40, rate: float = 0.3,
        ridge: float = 1e-3) -> ToxicityModel:
    """Trains on whole texts with labels 0/1. Without both labels the model calls everything clean.

    ``share`` is the share of toxic texts among all, where the sample's is another.
    """
    if len(set(toxic)) < 2:
        return ToxicityModel()
    y_doc = np.array(toxic)
    words = Words(pa.array(texts, pa.large_string()), pc.utf8_lower)
    per_word = [features(w) for w in words.unique]
    bad = _offending(words, y_doc, per_word)
    if not bad:
        return ToxicityModel()
    doc = words.doc_of()
    marked = np.array([any(f in bad for f in own) for own in per_word], bool)
    y = marked[words.codes] & (y_doc[doc] == 1)
    names = sorted(bad)
    index = {f: i for i, f in enumerate(names)}
    pairs = [(w, index[f]) for w, own in enumerate(per_word) for f in own if f in index]
    who, what = (np.array(x, np.int64) for x in zip(*pairs))
    lanes = _lanes(words.starts)
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    first = words.starts[:-1][words.lengths > 0]
    x = np.concatenate([np.zeros(len(names)), [-6.0, 0.0, 0.0, 0.0, 0.0]])  # words, bias, start, three moves
    m, v, n = np.zeros_like(x), np.zeros_like(x), max(1, int(y.sum()))
    seen_pairs = np.array([np.sum(~y[inner] & y[inner + 1]), np.sum(y[inner] & ~y[inner + 1]), np.sum(y[inner] & y[inner + 1])])
    for k in range(rounds):
        emit = np.full(len(per_word), x[-5])
        np.add.at(emit, who, x[what])
        score = emit[words.codes]
        odds, ahead, behind = marginals(score, words.starts, x[-4], tuple(x[-3:]), lanes)
        p = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        gap = p - y
        by_word = np.bincount(words.codes, gap, len(per_word))
        a, b = ahead[inner], np.exp(np.clip(score[inner + 1], -30, 30)) * behind[inner + 1]
        up, down, stay = np.exp(x[-3:])
        weight = np.stack([up * b, down * a, stay * a * b], 0)
        expected = (weight / (1 + weight.sum(0))).sum(1)
        grad = np.concatenate([np.bincount(what, by_word[who], len(names)), [gap.sum(), gap[first].sum()], expected - seen_pairs]) / n + ridge * x
        grad[-5] -= ridge * x[-5]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        x -= rate * (m / (1 - 0.9 ** (k + 1))) / (np.sqrt(v / (1 - 0.99 ** (k + 1))) + 1e-8)
    model = ToxicityModel({f: float(w) for f, w in zip(names, x) if abs(w) > 1e-3}, float(x[-5]), float(x[-4]), tuple(map(float, x[-3:])))
    odds, _, _ = marginals(np.array([model.emission(w) for w in words.unique])[words.codes], words.starts, model.start, model.moves, lanes)
    a, b, c = map(float, _logistic(_summary(odds, words.starts), y_doc))
    log_odds = lambda p: math.log(p / (1 - p))
    model.curve = (a + (log_odds(share) - log_odds(y_doc.mean()) if share and share < 1 else 0.0), b, c)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = 1000, longest: int = 6000) -> ToxicityModel:
    """Fits on the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic 0/1) marks.

    Of each label 2 x ``sample`` ids are drawn by a hash, and of those the first ``sample`` texts of at most ``longest`` characters
    reach the driver. An id with both labels counts as toxic; rows without label or text are not used.
    """
    marks = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    there = dict(marks.groupBy("toxic").count().collect())
    drawn = marks.withColumn("draw", F.xxhash64("doc_id", F.lit(7)))
    texts, toxic = [], []
    for label in (0, 1):
        ids = drawn.filter(F.col("toxic") == label).orderBy("draw", "doc_id").limit(2 * sample)
        rows = docs.select("doc_id", "text").filter(F.length("text") <= longest).join(F.broadcast(ids), "doc_id")
        for row in rows.orderBy("draw", "text").limit(sample).select("text").collect():
            texts.append(row[0])
            toxic.append(label)
    return fit(texts, toxic, there.get(1, 0) / max(there.get(0, 0) + there.get(1, 0), 1))


class _Scorer:
    def __init__(self, model: ToxicityModel):
        self.model = model

    def words(self, texts: pa.Array) -> tuple[Words, np.ndarray]:
        words = Words(texts, pc.utf8_lower)
        emission = self.model.emission
        emit = np.fromiter((emission(w) for w in words.unique), np.float64, len(words.unique))
        odds, _, _ = marginals(emit[words.codes], words.starts, self.model.start, self.model.moves)
        return words, odds

    def scores(self, odds: np.ndarray, starts: np.ndarray) -> np.ndarray:
        a, b, c = self.model.curve
        x = _summary(odds, starts)
        return 1 / (1 + np.exp(-(a + b * x[:, 0] + c * x[:, 1])))


def score_documents(docs: DataFrame, model: ToxicityModel, spans_over: float = 0.5) -> DataFrame:
    """(doc_id, score, spans): the score of every text, 0 to 1, and its toxic words.

    ``spans`` lists (start, end, probability) with code-point offsets of the words whose marginal is
    at least ``spans_over``, in order. A missing or empty text gets the score of a text without
    toxic words and no spans. Rows are scored one by one: repeated rows repeat, null ids stay null,
    an empty table gives no rows, other columns are ignored.
    """

    def make():
        scorer = _Scorer(model)
        least = math.log(spans_over / (1 - spans_over))

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = part.column("text")
            words, odds = scorer.words(texts)
            hits = np.flatnonzero(odds >= least)
            doc = words.doc_of()
            spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for i in np.unique(doc[hits]):
                at = hits[doc[hits] == i] - words.starts[i]
                found = [m.span() for m in _WORD.finditer(texts[int(i)].as_py())]
                spans[i] = [{"start": found[k][0], "end": found[k][1], "p": float(1 / (1 + np.exp(-odds[words.starts[i] + k])))} for k in at]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
            return pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(scorer.scores(odds, words.starts)), pa.array(spans, kind)], ["doc_id", "score", "spans"])

        return one

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return in_slices(rows, make, "doc_id long, score double, spans array<struct<start:long,end:long,p:double>>")


def keep_clean(docs: DataFrame, model: ToxicityModel, reject: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``reject``; a missing text counts as empty."""

    @tidy
    def run(batches):
        scorer = _Scorer(model)
        for part in slices(batches):
            texts = pc.fill_null(part.column("text"), "")
            words, odds = scorer.words(texts)
            yield part.filter(pa.array(scorer.scores(odds, words.starts) < reject))

    return docs.mapInArrow(run, docs.schema)
