"""Token-id files: predictions of orders 0 to 2 drive a range coder, in blocks that stand alone.

A block lists its distinct ids in the order they first come, and codes which of them comes next by their numbers in that list. The
numbers that followed the last two and the last one before are candidates for the next. Whether a candidate comes is a
yes or no that orders 2, 1 and 0 each give a probability for: by how sure the two-id and the one-id context are, and by how often the
block has held the candidate. The three are mixed in the logistic domain by adaptive weights, and the range coder codes
the answer with the mixed probability. Where no candidate hits, an adaptive yes or no tells whether the list's next id comes for the first
time; if not, the number is coded by the block's order-0 counts, current at every id.

All of it is integer arithmetic, so that any machine reads what another has written.

A block has its own model state, coder and checksum, so any block can be read without the others. Blocks of a task are
coded side by side: one step codes one id in each of many blocks by array operations.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import cut, slices, texts_of, tidy
from tickloom.llm.token_ids import TOKEN_SLICE, Encoder
from tickloom.sources.logs import file_system

BLOCK = 2048
LANES = 2560
# Ids are below this; a block's list holds them in 16 bits.
MOST_IDS = 1 << 16
_SLOTS2 = 4096
# Blocks whose ids are numbered at once.
_ROWS = 64
# Numbers of a list whose order-0 counts are summed up together, and how many of their 16-bit counts lie in a word of 64 bits.
_GROUP, _FOUR = 32, 4
_WORDS = np.arange(_GROUP // _FOUR)[:, None]
# Times a word of counts: in each place the sum of the counts up to it.
_SUMS = np.uint64(0x0001000100010001)
# What leaves the counts before a number of a group: a column per number, a row per word.
_BEFORE = np.array(
    [[(1 << 16 * min(max(own - _FOUR * w, 0), _FOUR)) - 1 for own in range(_GROUP)] for w in range(_GROUP // _FOUR)], np.uint64)
_LOW = np.uint64(1 << 48)
_16, _48 = np.uint64(16), np.uint64(48)
MAGIC = b"TLIDS\x02\x00\x00"


# Probabilities have 16 bits; their logits have 8 bits after the point.
_SQUASH = np.array([min(max(round(65536 / (1 + math.exp(-x / 256))), 48), 65488) for x in range(-2047, 2048)], np.int32)
_STRETCH = np.array([round(min(max(256 * math.log((p + 0.5) / (4095.5 - p)), -2047), 2047)) for p in range(4096)], np.int32)
_ALL, _WEIGHT, _RATE = 1 << 16, 1 << 16, 12
# Bounds of the probability that the list's next id comes.
_LEAST, _MOST = 512, 65024
# Probabilities that a block starts with, in percent: of a first candidate by order 2 (none, then how sure), by order 1 (none, agreeing,
# not agreeing) and by order 0 (times held); of a second candidate the same.
_START = np.array([
    [[8, 14, 35, 55, 75, 0, 0, 0, 0], [20, 15, 30, 45, 65, 10, 15, 15, 15], [5, 8, 12, 16, 20, 24, 28, 32, 0]],
    [[10, 10, 8, 8, 8, 0, 0, 0, 0], [8, 8, 14, 25, 40, 8, 14, 25, 40], [4, 6, 8, 11, 14, 18, 22, 26, 0]],
], np.int32)


class _Writer:
    """A range coder per lane, in 16-bit words; words that a carry has yet to pass are kept larger than that until the end."""

    def __init__(self, lanes: int, steps: int):
        self.low = np.zeros(lanes, np.uint64)
        self.span = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        # an id narrows a span by 39 bits at most
        self.width = 5 * steps // 2 + 8
        self.out = np.zeros(lanes * self.width, np.uint32)
        self.first = np.arange(lanes) * self.width
        self.at = self.first + 1  # the first word is there to be carried into

    def begin(self) -> None:
        self.before = self.low.copy()

    def chosen(self, i: np.ndarray, chance: np.ndarray, yes: np.ndarray) -> np.ndarray:
        """Narrows the lanes ``i`` to the answers ``yes``, whose chances are ``chance`` of 65536."""
        low, span = self.low.take(i), self.span.take(i)
        part = (span >> _16) * chance.astype(np.uint64)
        self.low[i] = np.where(yes, low, low + part)
        self.span[i] = np.where(yes, part, span - part)
        return yes

    def take(self, i: np.ndarray, part: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Narrows the lanes ``i`` to ``size`` parts from ``start`` on, of width ``part``."""
        self.low[i] += part * start.astype(np.uint64)
        self.span[i] = part * size.astype(np.uint64)

    def end(self) -> None:
        """Puts out what an id has settled; all its narrowings together carry at most once."""
        over = np.flatnonzero(self.low < self.before)
        if len(over):
            self.out[self.at[over] - 1] += np.uint32(1)
        i = np.flatnonzero(self.span < _LOW)
        while len(i):
            low, span, at = self.low.take(i), self.span.take(i), self.at.take(i)
            self.out[at] = low >> _48
            span <<= _16
            self.at[i], self.low[i], self.span[i] = at + 1, low << _16, span
            i = i[span < _LOW]

    def finish(self) -> list[bytes]:
        self.out[self.at] = (self.low >> _48) + (self.low & (_LOW - np.uint64(1)) > 0)
        while len(over := np.flatnonzero(self.out > 0xFFFF)):
            self.out[over] -= np.uint32(1 << 16)
            self.out[over - 1] += np.uint32(1)
        words = self.out.astype("<u2")
        return [words[a + 1 : b + 1].tobytes() for a, b in zip(self.first.tolist(), self.at.tolist())]


class _Reader:
    """What a ``_Writer`` wrote, read back; past the end of a lane come zeros."""

    def __init__(self, codes: list[bytes]):
        lanes, width = len(codes), max(map(len, codes)) // 2 + 4
        words = np.zeros((lanes, width), np.uint16)
        for k, code in enumerate(codes):
            words[k, : len(code) // 2] = np.frombuffer(code, "<u2")
        self.words = words.ravel()
        self.at = np.arange(lanes) * width
        self.last = self.at + (width - 1)
        self.span = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.code = np.zeros(lanes, np.uint64)
        for _ in range(4):
            self.code = (self.code << _16) | self.words[self.at]
            self.at += 1

    def begin(self) -> None:
        pass

    def chosen(self, i: np.ndarray, chance: np.ndarray, yes: None) -> np.ndarray:
        code, span = self.code.take(i), self.span.take(i)
        part = (span >> _16) * chance.astype(np.uint64)
        yes = code < part
        self.code[i] = np.where(yes, code, code - part)
        self.span[i] = np.where(yes, part, span - part)
        return yes

    def take(self, i: np.ndarray, part: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        self.code[i] -= part * start.astype(np.uint64)
        self.span[i] = part * size.astype(np.uint64)

    def end(self) -> None:
        i = np.flatnonzero(self.span < _LOW)
        while len(i):
            span, at = self.span.take(i), self.at.take(i)
            self.code[i] = (self.code.take(i) << _16) | self.words.take(np.minimum(at, self.last.take(i)))
            span <<= _16
            self.at[i], self.span[i] = at + 1, span
            i = i[span < _LOW]


class _Model:
    """Predictions of all lanes at one step, and their update. What it deals in are numbers in the lanes' lists of ids."""

    def __init__(self, lanes: int, steps: int):
        lane = np.arange(lanes)
        self.groups = -(-steps // _GROUP)
        self.base1, self.base2, self.base_chance, self.base_weight = lane * (self.groups * _GROUP), lane * _SLOTS2, lane * 54, lane * 10
        # a candidate and one more, times 4, and how sure it is; 0 for none
        self.first = np.zeros(lanes * self.groups * _GROUP, np.int16)
        self.second = np.zeros(lanes * _SLOTS2, np.int16)
        self.chances = np.tile((_START * 65536 // 100).ravel(), lanes)
        self.weights = np.full(3 * lanes * 10, _WEIGHT * 2 // 5, np.int32)
        self.of_order = np.arange(3)[:, None] * (lanes * 10)
        self.fresh = np.full(lanes * 6, _ALL // 2, np.int32)
        self.base_fresh, self.came = lane * 6, np.ones(lanes, np.int64)
        # order 0: how often each number has come, and how many have come that belong to groups before each
        self.times = np.zeros(lanes * self.groups * _GROUP, "<i2")
        self.below = np.zeros((self.groups, lanes), np.int16)
        self.group = np.arange(self.groups, dtype=np.int16)[:, None]
        self.lanes, self.now = lanes, 0
        self.held = np.zeros(lanes, np.int64)  # numbers that the lists have so far
        self.a, self.b = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """(first, second) candidate of each lane, -1 for none."""
        self.slot1 = self.base1 + self.a
        self.slot2 = self.base2 + ((self.a * 40503 + self.b * 60493 >> 4) & (_SLOTS2 - 1))
        self.e1, self.e2 = self.first.take(self.slot1), self.second.take(self.slot2)
        one, two = (self.e1 >> 2) - 1, (self.e2 >> 2) - 1
        none = two < 0
        agree = none | (one == two)
        self.sure2 = np.where(none, 0, (self.e2 & 3) + 1)
        self.sure1 = np.where(one >= 0, (self.e1 & 3) + np.where(agree, np.int16(1), np.int16(5)), 0)
        return np.where(none, one, two), np.where(agree, np.int16(-1), one)

    def mixed(self, i: np.ndarray, what: np.ndarray, turn: int) -> np.ndarray:
        """The chance, of 65536, that the candidates ``what`` of lanes ``i`` come; ``turn`` is 0 for the first, 1 for the second."""
        two = self.sure2.take(i)
        self.places = np.empty((3, len(i)), np.int64)
        self.places[0] = two
        self.places[1] = self.sure1.take(i) + np.int16(9)
        self.places[2] = np.minimum(self.times.take(self.base1.take(i) + what), 7) + np.int16(18)
        self.places += self.base_chance.take(i) + turn * 27
        self.rows = self.of_order + (self.base_weight.take(i) + turn * 5 + two)
        self.found = self.chances.take(self.places)
        self.logits = _STRETCH.take(self.found >> 4)
        self.pulls = self.weights.take(self.rows)
        # a block's weights stay below 2^22, so that nothing passes 32 bits
        logit = ((self.pulls >> 4) * self.logits).sum(axis=0, dtype=np.int32) >> 12
        self.chance = _SQUASH.take(np.minimum(np.maximum(logit, -2047), 2047) + 2047)
        return self.chance

    def learn(self, hit: np.ndarray) -> None:
        """What became of the candidates last asked for."""
        goal = hit.astype(np.int32) << 16
        missed = ((goal - self.chance) >> 4) * _RATE
        self.weights[self.rows] = self.pulls + ((self.logits * missed + (1 << 15)) >> 16)
        self.chances[self.places] = self.found + ((goal - self.found) >> 5)  # stays within 0 and 65505

    def chance_of_new(self, i: np.ndarray, tried: np.ndarray) -> np.ndarray:
        """The chance, of 65536, that the list's next id comes, after so many candidates that did not."""
        self.place = self.base_fresh.take(i) + 2 * tried + self.came.take(i)
        self.found = self.fresh.take(self.place)
        return np.minimum(np.maximum(self.found, _LEAST), _MOST)

    def learn_new(self, new: np.ndarray) -> None:
        self.fresh[self.place] = self.found + (((new.astype(np.int32) << 16) - self.found) >> 5)

    def _counts(self, i: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The counts of a group in each of the lanes ``i``, a row per word."""
        return self.times.view("<u8").take((self.base1.take(i) + group * _GROUP >> 2) + _WORDS)

    def share(self, i: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of the numbers ``x`` in lanes ``i`` among the ``now`` that have come."""
        group = x >> 5
        some = (self._counts(i, group) & _BEFORE.take(x & (_GROUP - 1), axis=1)).sum(axis=0)
        return self.below.ravel().take(group * self.lanes + i) + (some * _SUMS >> _48).astype(np.int64), self.times.take(self.base1.take(i) + x)

    def find(self, i: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(x, start, size): the numbers that hold the parts in lanes ``i``."""
        wanted = np.zeros(self.lanes, np.int16)
        wanted[i] = part
        used = self.now // _GROUP + 1
        group = (self.below[:used] <= wanted).view(np.uint8).sum(axis=0, dtype=np.uint8).take(i).astype(np.int64) - 1
        before = self.below.ravel().take(group * self.lanes + i).astype(np.int64)
        sums = self._counts(i, group) * _SUMS
        ends = (sums >> _48).astype(np.int64)
        for k in range(1, len(ends)):
            ends[k] += ends[k - 1]
        rest = part - before
        word = (ends[:-1] <= rest).view(np.uint8).sum(axis=0, dtype=np.uint8).astype(np.int64)
        at = word * len(i) + np.arange(len(i))
        inside = sums.ravel().take(at).view(np.int64)
        ahead = ends.ravel().take(at) - (inside >> 48)
        rest -= ahead
        a, b, c = inside & 0xFFFF, (inside >> 16) & 0xFFFF, (inside >> 32) & 0xFFFF
        own = (a <= rest).view(np.int8) + (b <= rest).view(np.int8) + (c <= rest).view(np.int8)
        x = group * _GROUP + word * _FOUR + own
        upto = (inside >> own * np.int64(16)) & 0xFFFF
        size = self.times.take(self.base1.take(i) + x)
        return x, before + ahead + upto - size, size

    def update(self, x: np.ndarray) -> None:
        replaced = ((x + 1) << 2).astype(np.int16)
        for table, slot, e in ((self.first, self.slot1, self.e1), (self.second, self.slot2, self.e2)):
            other = np.where(e & 3 > 0, e - np.int16(1), replaced)
            table[slot] = np.where(e ^ replaced < 4, np.minimum(e + np.int16(1), e | np.int16(3)), other)
        at = self.base1 + x
        self.times[at] = self.times.take(at) + np.int16(1)
        used = (self.now + 1) // _GROUP + 1
        if used < self.groups:
            # groups that may come into use later have all before them
            self.below[used] = self.now + 1
        used = min(used, self.groups)
        # -1 where a group comes after that of x
        self.below[:used] -= ((x >> 5).astype(np.int16) - self.group[:used]) >> 15
        new = x == self.held
        self.held += new
        self.came = new.astype(np.int64)
        self.b, self.a = self.a, x
        self.now += 1


def _steps(model: _Model, coder: _Writer | _Reader, steps: int, known: np.ndarray | None = None) -> np.ndarray:
    """Codes the numbers ``known`` (steps, lanes), or reads and returns them; the first of a lane is 0."""
    seen = np.zeros((steps, model.lanes), np.int16)
    model.candidates()
    model.update(np.zeros(model.lanes, np.int64))
    for t in range(1, steps):
        if known is None:
            x = np.full(model.lanes, -1, np.int64)
        else:
            x = known[t].astype(np.int64)
        coder.begin()
        open_, tried = np.ones(model.lanes, bool), np.zeros(model.lanes, np.int64)
        for turn, what in enumerate(model.candidates()):
            i = np.flatnonzero(open_ & (what >= 0))
            if len(i):
                guess = what.take(i)
                hit = coder.chosen(i, model.mixed(i, guess, turn), None if known is None else guess == x.take(i))
                model.learn(hit)
                tried[i] += 1
                i, guess = i[hit], guess[hit]
                open_[i] = False
                x[i] = guess
        i = np.flatnonzero(open_)
        if len(i):
            next_ = model.held.take(i)
            new = coder.chosen(i, model.chance_of_new(i, tried.take(i)), None if known is None else next_ == x.take(i))
            model.learn_new(new)
            x[i[new]] = next_[new]
            i = i[~new]
        if len(i):
            part = coder.span.take(i) // np.uint64(t)
            if known is None:
                x[i], start, size = model.find(i, np.minimum(coder.code.take(i) // part, np.uint64(t - 1)).astype(np.int16))
            else:
                start, size = model.share(i, x.take(i))
            coder.take(i, part, start, size)
        coder.end()
        model.update(x)
        seen[t] = x
    return seen


def _numbered(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id's number in its row's list of ids by first place, and whether it is there for the first time."""
    lanes, steps = blocks.shape
    bits = steps.bit_length()
    step = np.arange(steps, dtype=np.int32)
    row = np.arange(lanes, dtype=np.int32)[:, None] * np.int32(steps)
    key = (blocks.astype(np.int32) << bits) | step
    key.sort(axis=1)
    new = np.ones(key.shape, bool)
    new[:, 1:] = (key[:, 1:] ^ key[:, :-1]) >> bits > 0
    key &= (1 << bits) - 1
    key += row
    # ids alike are in order of their places, so each has its list's place from the first of them
    origin = np.empty(lanes * steps, np.int32)
    origin[key.ravel()] = np.repeat(key[new], np.diff(np.flatnonzero(new), append=key.size))
    first = origin.reshape(lanes, steps) == row + step
    return (first.cumsum(axis=1, dtype=np.int16).ravel().take(origin) - np.int16(1)).reshape(lanes, steps), first


def encode_blocks(blocks: np.ndarray) -> list[bytes]:
    """The code of every row of ``blocks`` (lanes, steps); rows are coded independently. Ids of ``MOST_IDS`` and more are an error.

    A code: the number of distinct ids and these as unsigned 16-bit integers, then the range coder's words.
    """
    lanes, steps = blocks.shape
    if steps > BLOCK:
        raise ValueError(f"a block has at most {BLOCK} ids")
    if blocks.size and (blocks.min() < 0 or blocks.max() >= MOST_IDS):
        raise ValueError(f"token ids must be below {MOST_IDS}")
    known, lists = np.empty((steps, lanes), np.int16), []
    for k in range(0, lanes, _ROWS):
        rows = blocks[k : k + _ROWS]
        numbers, first = _numbered(rows)
        known[:, k : k + _ROWS] = numbers.T
        lists += [row[new].astype("<u2") for row, new in zip(rows, first)]
    coder = _Writer(lanes, steps)
    _steps(_Model(lanes, steps), coder, steps, known)
    return [struct.pack("<H", len(ids)) + ids.tobytes() + code for ids, code in zip(lists, coder.finish())]


def decode_blocks(codes: list[bytes], steps: int) -> np.ndarray:
    """The first ``steps`` ids of each row that ``encode_blocks`` coded; past a row's end come any."""
    lists = np.zeros((len(codes), max(steps, BLOCK)), np.int32)
    words = []
    for k, code in enumerate(codes):
        n = int.from_bytes(code[:2], "little")
        lists[k, :n] = np.frombuffer(code, "<u2", n, 2)
        words.append(code[2 + 2 * n :])
    seen = _steps(_Model(len(codes), steps), _Reader(words), steps)
    return np.take_along_axis(lists, seen.T.astype(np.int64), axis=1)


def _even(blocks: int) -> int:
    """Blocks of a group, where so many are coded in groups of about ``LANES`` that are as large as each other."""
    return max(1, -(-blocks // max(1, round(blocks / LANES))))


def _coded(ids: np.ndarray) -> Iterator[bytes]:
    """Blocks of ``ids`` as they stand in a file: length, size and checksum, then the code.

    A short last block is coded beside the others, as long as they are: its last id comes again until then, and is left out in reading.
    """
    lengths = [BLOCK] * (len(ids) // BLOCK) + [len(ids) % BLOCK] * (len(ids) % BLOCK > 0)
    if len(lengths) > 1:
        ids = np.concatenate((ids, np.repeat(ids[-1:], BLOCK - lengths[-1])))
    rows = ids.reshape(len(lengths), -1) if lengths else ids.reshape(0, BLOCK)
    size = _even(len(rows))
    for k in range(0, len(rows), size):
        group = rows[k : k + size]
        for row, n, code in zip(group, lengths[k : k + size], encode_blocks(group)):
            yield struct.pack("<III", n, len(code), zlib.crc32(row[:n].astype("<u4").tobytes())) + code


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0) -> DataFrame:
    """Writes the ids of all ``docs`` (doc_id, text) to files in ``folder``, in ascending order of doc_id over all files.

    A text's ids (missing text: none) end with ``end_id``. Returns (part, file, n_docs, n_ids), a row per file; files of lost or repeated
    tasks are never listed. Repeated rows follow each other; null ids come first. No documents make no files.

    A file: magic; blocks (ids, bytes and CRC-32 as unsigned 32-bit integers, then the code of these ids); the zlib-compressed table of documents
    (which have no id, all ids, all lengths); its size, the blocks' and the documents' number as unsigned 64-bit integers.
    """
    @tidy
    def run(batches):
        encoder = Encoder(tokenizer)
        task = TaskContext.get()
        path = f"{folder}/ids-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        fs, local = file_system(path)
        fs.create_dir(local.rsplit("/", 1)[0], recursive=True)
        doc_ids, lengths, held, n_held, blocks, total = [], [], [], 0, 0, 0
        with fs.open_output_stream(local) as out:
            out.write(MAGIC)
            for part in slices(batches, limit=TOKEN_SLICE):
                starts, flat = encoder.encode(part.column("text"))
                ends = np.insert(flat, starts[1:], np.uint32(end_id))
                doc_ids += part.column("doc_id").to_pylist()
                lengths.append(np.diff(starts) + 1)
                held.append(ends)
                n_held += len(ends)
                # the rest makes groups of their own, which should not be small
                if n_held >= 2 * BLOCK * LANES:
                    ids = np.concatenate(held)
                    full = (len(ids) // (BLOCK * LANES) - 1) * BLOCK * LANES
                    for block in _coded(ids[:full]):
                        out.write(block)
                        blocks += 1
                    held, n_held, total = [ids[full:]], len(ids) - full, total + full
            for block in _coded(np.concatenate(held) if held else np.zeros(0, np.uint32)):
                out.write(block)
                blocks += 1
            total += n_held
            missing = np.array([d is None for d in doc_ids], np.uint8)
            table = missing.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.concatenate(lengths or [np.zeros(0)]).astype("<i8").tobytes()
            table = zlib.compress(table)
            out.write(table + struct.pack("<QQQ", len(table), blocks, len(doc_ids)))
        if doc_ids:
            yield pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (task.partitionId(), path, len(doc_ids), int(total))], ["part", "file", "n_docs", "n_ids"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts_of(docs).repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return cut(ordered.mapInArrow(run, "part long, file string, n_docs long, n_ids long"))


def read_file(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of every document of a file; a block whose checksum fails raises an error."""
    fs, local = file_system(path)
    with fs.open_input_file(local) as f:
        size = f.size()
        table_size, blocks, docs = struct.unpack("<QQQ", f.read_at(24, size - 24))
        table = zlib.decompress(f.read_at(table_size, size - 24 - table_size))
        missing = np.frombuffer(table, np.uint8, docs)
        doc_ids, lengths = np.frombuffer(table, "<i8", docs, docs), np.frombuffer(table, "<i8", docs, docs * 9)
        if f.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is no file of token ids")

        def decoded() -> Iterator[np.ndarray]:
            at, held, most = len(MAGIC), [], _even(blocks)
            for _ in range(blocks):
                n, n_bytes, crc = struct.unpack("<III", f.read_at(12, at))
                held.append((n, f.read_at(n_bytes, at + 12), crc))
                at += 12 + n_bytes
                if len(held) == most:
                    yield from _checked(held, path)
                    held = []
            if held:
                yield from _checked(held, path)

        source, rest = decoded(), np.zeros(0, np.int32)
        for doc, n, none in zip(doc_ids.tolist(), lengths.tolist(), missing.tolist()):
            parts, have = [rest], len(rest)
            while have < n:
                parts.append(next(source))
                have += len(parts[-1])
            ids = np.concatenate(parts) if len(parts) > 1 else rest
            rest = ids[n:]
            yield (None if none else doc), ids[:n]


def _checked(held: list[tuple[int, bytes, int]], path: str) -> Iterator[np.ndarray]:
    lengths = [n for n, _, _ in held]
    if max(lengths) > BLOCK:
        raise ValueError(f"a block of {path} is damaged")
    rows = decode_blocks([code for _, code, _ in held], max(lengths))
    for row, (n, _, crc) in zip(rows, held):
        if zlib.crc32(row[:n].astype("<u4").tobytes()) != crc:
            raise ValueError(f"a block of {path} is damaged")
    yield np.concatenate([row[:n] for row, n in zip(rows, lengths)])


def read_ids(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents in the files of ``write_ids``.

    ``start`` is the number of ids before the document in all files, ``ids_crc32`` the CRC-32 of its ids as
    little-endian unsigned 32-bit integers.
    """
    listed = sorted(tuple(r) for r in files.select("part", "file", "n_ids").collect())  # a row per file
    starts = np.cumsum([0, *(n for _, _, n in listed)]).tolist()
    rows = [(path, start) for (_, path, _), start in zip(listed, starts)]

    @tidy
    def run(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                (path, start), out = rows[k], []
                for doc, ids in read_file(path):
                    out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(out) == 20_000:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)

    # a partition per file
    numbers = files.sparkSession.range(0, len(rows), 1, max(len(rows), 1))
    return numbers.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """Writes the ids of ``docs`` below ``folder`` and reads the files back."""
    return read_ids(write_ids(docs, tokenizer, folder))
