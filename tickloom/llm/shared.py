"""Helpers the operators share: lineage cuts, Arrow batches of whole texts, words, hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import scratch_dir

# Text bytes a task works on at once; a longer text is a slice by itself.
SLICE_BYTES = 2 << 20


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared checkpoint folder, without their lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint(eager=True)


# Rows of ids and numbers that a task takes.
_TASK_ROWS = 20_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of so many rows in as many partitions as these need, two for each core at least.

    A shuffle writes files for each partition, so a small table in many partitions costs far more than its rows.
    """
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, rows // _TASK_ROWS))


def cut_small(df: DataFrame) -> DataFrame:
    """``cut``, then ``gathered``."""
    df = cut(df)
    return gathered(df, df.count())


def texts_of(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id long, text string) with a missing text as the empty one; other columns are left out."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def tidy(run: Callable) -> Callable:
    """A function over a task's batches that hands the memory it has freed back to the system at the end.

    Workers live on between tasks, and what they keep counts against the executor.
    """

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return wrapped


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // limit
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def in_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str,
              limit: int = SLICE_BYTES) -> DataFrame:
    """Rows from slices of ``df``; ``make`` runs once per task and returns the function for a slice."""

    @tidy
    def run(batches):
        one = make()
        for part in slices(batches, limit=limit):
            yield one(part)

    return df.mapInArrow(run, schema)


class Words:
    """The words of a slice of texts: ``codes`` into ``unique``, and where each text starts among them."""

    def __init__(self, texts: pa.Array, lower: Callable = pc.ascii_lower):
        texts = texts.cast(pa.large_string()) if pa.types.is_string(texts.type) and texts.nbytes > 1 << 30 else texts
        lists = pc.ascii_split_whitespace(lower(texts))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
        codes = values.indices.to_numpy()
        self.unique: list[str] = values.dictionary.to_pylist()
        starts = offsets - offsets[0]
        blank = values.dictionary.index("").as_py()
        if blank >= 0:
            real = codes != blank
            starts = np.concatenate(([0], np.cumsum(real)))[starts]
            codes = codes[real]
        self.codes, self.starts = codes, starts

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per distinct word."""
        return hash_strings(self.unique)

    def doc_of(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.starts) - 1), self.lengths)


def hash_strings(values: list[str]) -> np.ndarray:
    if not values:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(values, dtype=object), categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gather_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of every run, one run after the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 30 and (not len(starts) or starts.max() < 1 << 30) else np.int64
    out = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out
