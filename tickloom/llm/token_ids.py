"""Token ids of whole texts by the tokenizers library.

A byte-level vocabulary never joins a space and a visible character to what stands before
them, nor punctuation or a line end to the letter before it. So a slice of texts is cut there
and encoded from its distinct pieces.
"""

from __future__ import annotations

import itertools
import os
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tickloom.llm.shared import gather_runs

# Cuts are made only at characters that are letters, visible or punctuation in every Unicode version; "'" may join.
_SPACE, _LETTER, _STOP, _WIDE, _TRAIL = (1 << k for k in range(5))
_KIND = np.zeros(256, np.uint8)  # what a byte of UTF-8 text may be
_KIND[0x21:0x7F] |= _SPACE  # a visible character after a space
for _c in string.ascii_letters:
    _KIND[ord(_c)] |= _LETTER
for _c in set(string.punctuation + "\n") - {"'"}:
    _KIND[ord(_c)] |= _STOP  # what ends a word
_KIND[0xC3:0xC9] |= _SPACE | _WIDE  # the first byte of U+00C0 to U+023F
_KIND[0x80:0xC0] |= _TRAIL
# Pieces that stay apart from line ends around them.
_PLAIN = re.compile(r" ?[!-~\u00a1-\u024f]+").fullmatch
_RUN, _JOINED = 4096, 64
# Text bytes encoded at once.
TOKEN_SLICE = 2 << 20
# Pieces, and bytes of one, whose ids an encoder keeps for later slices.
_KEPT, _KEPT_SIZE = 1 << 18, 40


def _cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pieces of texts in UTF-8 start, and the end of the last; ``ends`` are the places between texts, first and last included."""
    cut = np.zeros(len(data) + 1, bool)
    cut[ends] = True
    space = np.flatnonzero(data[:-1] == 0x20)
    space = space[(_KIND[data[space + 1]] & _SPACE > 0) & ~cut[space + 1]]
    stop = np.flatnonzero(_KIND[data] & _STOP)
    stop = stop[stop > 0]
    last = data[stop - 1]
    letter = _KIND[last] & _LETTER > 0
    wide = np.flatnonzero((_KIND[last] & _TRAIL > 0) & (stop > 1))
    first, second = data[stop[wide] - 2], last[wide]
    # the signs for times and division lie among the letters
    letter[wide] = (_KIND[first] & _WIDE > 0) & ~((first == 0xC3) & ((second == 0x97) | (second == 0xB7)))
    cut[space] = True
    cut[stop[letter]] = True
    return np.flatnonzero(cut)


class Encoder:
    """``encode`` gives the ids that ``Tokenizer.encode(text, add_special_tokens=False)`` gives.

    No text is shortened: one that holds a special token is encoded uncut, and one that is longer
    than a slice is encoded in parts that end where pieces end.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_end = line_end[0] if len(line_end) == 1 else None
        self.whole = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.size[i] = len(token)  # a character of a token is a byte of text
        # pieces of former slices: where their ids start, how many they are, and all ids
        self.known = pa.array([], pa.string())
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's ids start (one more than texts), and all ids as unsigned 32-bit integers."""
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        if len(texts) and (size.max() > TOKEN_SLICE or any(pc.any(pc.match_substring(texts, w)).as_py() for w in self.whole)):
            each = [self._one(texts.slice(i, 1)) for i in range(len(texts))]
            return np.concatenate(([0], np.cumsum([len(x) for x in each]))), np.concatenate(each)
        return self._pieces(texts)

    def _one(self, text: pa.Array) -> np.ndarray:
        whole = text[0].as_py()
        if any(w in whole for w in self.whole):
            return np.array(self.tokenizer.encode(whole, add_special_tokens=False).ids, np.uint32)
        parts, at, step = [], 0, TOKEN_SLICE // 4
        while len(whole) - at > step:
            end = at + step
            while 0 <= end < len(whole) - 1 and not (whole[end] == " " and "!" <= whole[end + 1] <= "~"):
                end = whole.find(" ", end + 1)
            if not at < end < len(whole) - 1:
                break
            parts.append(whole[at:end])
            at = end
        parts.append(whole[at:])
        return np.concatenate([self._pieces(pa.array([p]))[1] for p in parts])

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        _, places, data = texts.buffers()
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        offsets = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        lo, hi = int(offsets[0]), int(offsets[-1])
        if lo == hi:
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint32)
        offsets -= lo
        data = data.slice(lo, hi - lo)
        cuts = _cuts(np.frombuffer(data, np.uint8), offsets)
        cut = pa.LargeStringArray if hi - lo >= 1 << 31 else pa.StringArray
        places = cuts if cut is pa.LargeStringArray else cuts.astype(np.int32)
        pieces = cut.from_buffers(len(cuts) - 1, pa.py_buffer(places), data).dictionary_encode()
        starts, lengths, flat = self._looked_up(pieces.dictionary)
        codes = pieces.indices.to_numpy()
        each = lengths[codes]
        out = flat[gather_runs(starts[codes], each)]
        return np.concatenate(([0], np.cumsum(each, dtype=np.int64)))[np.searchsorted(cuts, offsets)], out

    def _looked_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ``_distinct`` gives; short pieces of former slices, up to a number of them, are not encoded again."""
        slots = pc.fill_null(pc.index_in(pieces, self.known.cast(pieces.type)), -1).to_numpy().astype(np.int64)
        fresh = np.flatnonzero(slots < 0)
        new = pieces.take(pa.array(fresh))
        starts, lengths, flat = self.starts, self.lengths, self.flat
        short = pc.binary_length(new).to_numpy() <= _KEPT_SIZE
        for some, kept in ((short, True), (~short, False)):
            own = new.filter(pa.array(some))
            slots[fresh[some]] = len(starts) + np.arange(len(own))
            more = self._distinct(own.to_numpy(zero_copy_only=False).tolist())
            starts, lengths, flat = (np.concatenate(x) for x in ((starts, more[0] + len(flat)), (lengths, more[1]), (flat, more[2])))
            if kept and len(self.known) + len(own) <= _KEPT:
                self.known = pa.concat_arrays([self.known, own.cast(pa.string())])
                self.starts, self.lengths, self.flat = starts, lengths, flat
        return starts[slots], lengths[slots], flat

    def _distinct(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each piece start, how many they are, and all ids.

        A piece of a space and visible characters is joined to nothing before or behind it, so these are encoded many at once
        and told apart by the bytes of their ids. Other pieces without white space inside are encoded in runs with line ends between them,
        which no piece can join. A run whose pieces don't come out one by one is encoded piece by piece, as all others are.
        """
        starts, lengths = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int32)
        parts, total = [], 0
        single, led, plain = [], [], []
        for i, p in enumerate(pieces):
            (single if not _PLAIN(p) else led if p[0] == " " else plain if self.line_end is not None else single).append(i)
        for a in range(0, len(led), _RUN):
            run = led[a : a + _RUN]
            words = [pieces[i] for i in run]
            joined = ["".join(words[k : k + _JOINED]) for k in range(0, len(words), _JOINED)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
            places = np.cumsum(self.size[ids])
            goal = np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in words])
            ends = np.searchsorted(places, goal) + 1
            if places[-1] != goal[-1] or (places[ends - 1] != goal).any():
                single += run
                continue
            lengths[run] = np.diff(ends, prepend=0)
            starts[run] = total + ends - lengths[run]
            parts.append(ids)
            total += len(ids)
        for a in range(0, len(plain), _RUN):
            run = plain[a : a + _RUN]
            joined = self.tokenizer.encode_batch_fast(["\n".join([pieces[i] for i in run])], add_special_tokens=False)
            ids = np.array(joined[0].ids, np.uint32)
            ends = np.flatnonzero(ids == self.line_end)
            if len(ends) != len(run) - 1:
                single += run
                continue
            edges = np.concatenate(([-1], ends, [len(ids)]))
            lengths[run] = np.diff(edges) - 1
            starts[run] = total + edges[:-1] + 1
            parts.append(ids)
            total += len(ids)
        single.sort()
        for a in range(0, len(single), _RUN):
            run = single[a : a + _RUN]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[i] for i in run], add_special_tokens=False)]
            lengths[run] = [len(x) for x in ids]
            starts[run] = total + np.cumsum(lengths[run], dtype=np.int64) - lengths[run]
            parts.append(np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lengths[run].sum())))
            total += len(parts[-1])
        return starts, lengths, np.concatenate(parts) if parts else np.zeros(0, np.uint32)
