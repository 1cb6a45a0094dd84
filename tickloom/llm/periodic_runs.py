"""Periodic runs of words: stretches that repeat a short passage over and over.

The words of a text get the dictionary of their basic factors, level by level: level k names every stretch of
2**k words by the pair of names of its halves, the same name for the same words. A factor's next occurrence
within twice its length is a step; two equal steps one after the other are an arithmetic progression of
occurrences, and their step is proposed as a period. Proposals that start where their period starts are extended
to the right word by word, and those that say the same stretch become one run with its smallest period.

A run with at least four periods q is a proposal of the level with q <= 2**k < 2q: there every occurrence of its
factors is q after the one before, and at least three of them lie in the run. So none is missed.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tickloom.llm.shared import Words, gather_runs, in_slices, texts_of

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
# Which word stands at each place: (doc_id or None, number of words) -> places, or None for the words as they are.
Places = Callable[[int | None, int], "np.ndarray | None"]


def _steps(names: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, at, step) of the factors that occur more than once; step to the next occurrence, 0 at the last.

    ``at`` ascends; the names that come back are dense.
    """
    order = np.sort(names << 32 | np.arange(len(names)))
    name, place = order >> 32, order & 0xFFFFFFFF
    again = np.zeros(len(order), bool)
    again[1:] = name[1:] == name[:-1]
    more = again.copy()
    more[:-1] |= again[1:]
    step = np.zeros(len(order), np.int64)
    step[:-1][again[1:]] = at[place[1:][again[1:]]] - at[place[:-1][again[1:]]]
    kept = np.flatnonzero(more)
    back = np.argsort(place[kept])
    dense = np.cumsum(~again[kept]) - 1
    return dense[back], at[place[kept][back]], step[kept][back]


def _proposals(at: np.ndarray, step: np.ndarray, width: int, codes: np.ndarray, first: np.ndarray):
    """(start, end, period) of the progressions of this level that start where their period does.

    Consecutive places with one step are one stretch. ``end`` is where its first occurrence's repetition ends: no
    word between is known to agree where the period is longer than the factor.
    """
    far = np.zeros(len(at), np.int64)  # the step of the next occurrence
    near = (step > 0) & (step <= 2 * width)
    far[near] = step[np.searchsorted(at, at[near] + step[near])]
    good = near & (far == step)
    head = good.copy()
    head[1:] &= ~(good[:-1] & (at[1:] == at[:-1] + 1) & (step[1:] == step[:-1]))
    start, period = at[head], step[head]
    same = start > first[start]
    same[same] = codes[start[same] - 1] == codes[start[same] - 1 + period[same]]
    start, period = start[~same], period[~same]
    return start, start + period + width, period


def _extend(end: np.ndarray, period: np.ndarray, stop: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """How far the words before ``end`` go on with their period; windows double as long as all of one agrees."""
    end, window, live = end.copy(), 16, np.arange(len(end))
    while len(live):
        size = np.minimum(window, stop[live] - end[live])
        places = gather_runs(end[live], size)
        differs = codes[places] != codes[places - np.repeat(period[live], size)]
        cuts = np.concatenate(([0], np.cumsum(size)))
        wrong = np.flatnonzero(differs)
        nearest = np.searchsorted(wrong, cuts[:-1])
        fits = np.minimum(np.append(wrong, len(places))[nearest] - cuts[:-1], size)
        end[live] += fits
        live = live[(fits == size) & (end[live] < stop[live])]
        window *= 2
    return end


def runs_of(codes: np.ndarray, starts: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """Rows (start, end, period) of all runs in ``codes``, whose texts start at ``starts`` (one more than texts).

    A run has at least ``least`` words and ``times`` of its smallest periods (four or more), lies in one text, and
    no word beside it goes on with the period. Ordered by start, then period.
    """
    lengths = np.diff(starts)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    first, stop = starts[:-1][doc], starts[1:][doc]
    at, width, found = np.arange(len(codes)), 1, []
    names = pd.factorize(doc * (int(codes.max()) + 1 if len(codes) else 1) + codes)[0].astype(np.int64)
    while True:
        names, at, step = _steps(names, at)
        if not len(at):
            break
        start, end, period = _proposals(at, step, width, codes, first)
        found.append(np.stack([start, _extend(end, period, stop[start], codes), period], 1))
        # the longest text decides: a period is at most a quarter of a text, and its level less than twice that
        inside = at + 2 * width <= stop[at]
        left, right = at[inside], at[inside] + width
        spot = np.minimum(np.searchsorted(at, right), len(at) - 1)
        both = at[spot] == right
        if not both.any() or 4 * width > lengths.max():
            break
        pair = names[inside][both] * len(at) + names[spot[both]]
        names, at, width = pd.factorize(pair)[0].astype(np.int64), left[both], 2 * width
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    runs = runs[(runs[:, 1] - runs[:, 0]) >= np.maximum(least, times * runs[:, 2])]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # a multiple of a stretch's smallest period is proposed too where it is long enough
    again = np.zeros(len(runs), bool)
    again[1:] = (runs[1:, :2] == runs[:-1, :2]).all(1)
    runs = runs[~again]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _collapse(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words stay: those in no run, or only within the first period of their runs."""
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, runs[:, 0] + runs[:, 2], 1)
    np.add.at(inside, runs[:, 1], -1)
    return np.cumsum(inside[:-1]) == 0


def _lists(starts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), values)


def _find(least: int, times: int, places: Places | None):
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column("text"), lambda texts: texts)
        codes, starts = words.codes.astype(np.int64), words.starts.astype(np.int64)
        if places is not None:
            codes = codes.copy()
            for i, key in enumerate(batch.column("doc_id").to_pylist()):
                own = places(key, int(starts[i + 1] - starts[i]))
                if own is not None:
                    codes[starts[i] : starts[i + 1]] = codes[starts[i] + own]
        runs = runs_of(codes, starts, least, times)
        kept = _collapse(runs, len(codes))
        stays = np.concatenate(([0], np.cumsum(kept)))[starts]
        text = pa.array(words.unique, pa.string()).take(pa.array(codes[kept]))
        joined = pc.binary_join(_lists(stays, text), " ")
        edges = np.searchsorted(runs[:, 0], starts)
        owner = np.repeat(starts[:-1], np.diff(edges))
        rows = pa.StructArray.from_arrays(
            [pa.array(runs[:, 0] - owner), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], ["start", "length", "period"])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(starts)), _lists(edges, rows), joined], ["doc_id", "n_words", "runs", "collapsed"])

    return lambda: one


def find_runs(docs: DataFrame, least: int = 6, times: int = 4, places: Places | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of ``docs`` (doc_id, text).

    Words are what stands between ASCII white space. A run is (start, length, period), starts counted from 0, as
    ``runs_of`` says; ``collapsed`` is the text of all words that no run holds after its first period, joined by
    one space. ``places`` may say which words stand at the places of a text instead. Each row stands for
    itself: rows that repeat an id or a text repeat their result. A missing text, an empty one and one of white
    space alone have no words, no runs and an empty collapsed text; a missing id stays missing. Other columns are
    left out, an empty table gives no rows. Texts are read whole, and nothing is shuffled.
    """
    if times < 4 or least < 1:
        raise ValueError("a run has at least four periods and a word")
    return in_slices(texts_of(docs), _find(least, times, places), SCHEMA)


def repeated_tail(key: int | None, n: int) -> np.ndarray | None:
    """The places of a text whose end repeats a passage, for a tenth of the ids by checksum; a missing id has none."""
    if key is None or n == 0:
        return None
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    own = np.arange(n)
    own[a:] = a + (own[a:] - a) % p
    return own
