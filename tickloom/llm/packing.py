"""Vector bin packing of token pieces into training sequences.

A sequence has limits on tokens, on pieces (segments) and on tokens that bear loss. The next piece
of an open sequence is the one with the largest dot product of its needs with what is left
of the sequence, both as shares of the limits, so that it fits where it uses the scarce room best. Where
none fits whole and cutting is allowed, the best one is cut to what is left.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tickloom.llm.shared import slices, texts_of, tidy
from tickloom.llm.token_ids import TOKEN_SLICE, Encoder

# Items packed together; a task packs one group after the other.
GROUP = 2048


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


def pack(tokens: np.ndarray, loss: np.ndarray, limits: Limits, cutting: bool = True) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, length) for items with ``tokens`` and ``loss`` bearing tokens.

    The loss-bearing tokens of an item are its last ones. With ``cutting`` every id lies in exactly one piece;
    without, an item beyond the limits by itself is left out. Items without tokens get no piece. Ties go to the earlier item.
    """
    cap = np.array([limits.tokens, limits.segments, limits.loss], np.float64)
    need = np.stack([tokens, np.ones(len(tokens)), np.minimum(loss, tokens)], 1).astype(np.float64)
    start = np.zeros(len(tokens), np.int64)
    share = need / cap
    live = tokens > 0
    if not cutting:
        live &= (need <= cap).all(1)
    out: list[list[tuple[int, int, int]]] = []
    left = int(live.sum())
    while left:
        room, bin_ = cap.copy(), []
        while left and room.min() >= (0 if not cutting else 1) and room[0] >= 1 and room[1] >= 1:
            gain = share @ (room / cap)
            fits = live & (need[:, 0] <= room[0]) & (need[:, 1] <= room[1]) & (need[:, 2] <= room[2])
            if fits.any():
                i = int(np.argmax(np.where(fits, gain, -1.0)))
                n = int(need[i, 0])
            elif cutting:
                i = int(np.argmax(np.where(live, gain, -1.0)))
                # the front of an item bears no loss until only its loss-bearing tokens are left
                free = need[i, 0] - need[i, 2]
                n = int(min(room[0], free + room[2], need[i, 0]))
                if n < 1:
                    break
            else:
                break
            used = max(0.0, n - (need[i, 0] - need[i, 2]))
            bin_.append((i, int(start[i]), n))
            room -= (n, 1, used)
            start[i] += n
            need[i] -= (n, 0, used)
            share[i] = need[i] / cap
            if need[i, 0] <= 0:
                live[i] = False
                left -= 1
        out.append(bin_)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 1, group: int = GROUP) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): the pieces of all documents, packed.

    A document is its text's ids (missing text: none) and ``end_id``; every token but the first bears loss.
    Documents are first cut into full sequences, whose number grows with the text only; the remainders are packed in groups of
    ``group`` per task. ``sequence_id`` is made of the task's number and a count, so a task that runs again gives
    the same ids. Rows are packed one by one: repeated rows repeat their pieces, a null id stays null, an empty
    table gives no rows, other columns are ignored.
    """

    @tidy
    def run(batches):
        encoder = Encoder(tokenizer)
        bin_id = TaskContext.get().partitionId() << 36
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        held: list[tuple] = []  # (doc_id, start of the rest, the rest's ids, doc_tokens)

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

        def flush():
            nonlocal bin_id
            sizes = np.array([len(x[2]) for x in held], np.int64)
            loss = sizes - np.array([x[1] == 0 for x in held], np.int64)
            rows = []
            for pieces in pack(sizes, loss, limits):
                offset = 0
                for i, at, n in pieces:
                    doc, base, ids, total = held[i]
                    rows.append((doc, base + at, n, zlib.crc32(ids[at : at + n].tobytes()), total, bin_id, offset))
                    offset += n
                bin_id += 1
            held.clear()
            return emit(rows)

        full = min(limits.tokens, limits.loss)
        for part in slices(batches, limit=TOKEN_SLICE):
            starts, flat = encoder.encode(part.column("text"))
            rows = []
            for i, doc in enumerate(part.column("doc_id").to_pylist()):
                ids = np.append(flat[starts[i] : starts[i + 1]], np.uint32(end_id)).astype("<u4")
                whole = len(ids) // full * full
                for at in range(0, whole, full):
                    rows.append((doc, at, full, zlib.crc32(ids[at : at + full].tobytes()), len(ids), bin_id, 0))
                    bin_id += 1
                if whole < len(ids):
                    held.append((doc, whole, ids[whole:].copy(), len(ids)))
                if len(held) >= group:
                    if rows:
                        yield emit(rows)
                        rows = []
                    yield flush()
            if rows:
                yield emit(rows)
        if held:
            yield flush()

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return texts_of(docs).mapInArrow(run, kind)
