"""Exact byte-pair encoding by backtracking, and decoding by an offset table.

For a vocabulary whose tokens each come from one merge, a row of tokens is the encoding of its text exactly when each two
neighbours are compatible, that is, when encoding their joined text gives the two again. So a word is read once by an
Aho-Corasick automaton that notes the longest token starting at each place; tokens are taken from left to right, the
longest compatible one first; where none fits, the place is marked as dead and the token before it is shortened. No
place is tried twice, so the time is linear in the word.

The library named by the vocabulary file only normalises and splits what is not plain ASCII; it encodes nothing.
"""

from __future__ import annotations

import functools
import json
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tickloom.llm.shared import Words, gather_runs, in_slices, slices, texts_of, tidy

# The mark of a word's last symbol; no symbol of a byte-level vocabulary is this character.
END = "\x00"
# Words and pairs a task keeps; what is forgotten is worked out again.
REMEMBERED = 400_000
_NEVER = 1 << 62
# Visible ASCII and the letters of Latin-1: normal as they are, and letters or not in every Unicode version.
_PLAIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
# How this kind of vocabulary splits such text in lower case (fixed values of its file).
_PLAIN_SPLIT = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+").findall


class Merges:
    """The vocabulary's tables: tokens by length, what each is made of, and which neighbours stay apart."""

    def __init__(self, vocabulary: dict[str, int], merges: list[list[str]], suffix: str):
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[tuple[int, int], int] = {}
        rank: dict[int, int] = {}
        for k, (a, b) in enumerate(merges):
            left, right, token = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if token in self.parts or max(rank.get(left, -1), rank.get(right, -1)) >= k:
                raise ValueError("a token has two merges, or is merged before it is made")
            self.parts[token], self.made[left, right], rank[token] = (left, right), token, k
        self.rank = rank
        texts: dict[int, str] = {}
        for text, token in sorted(vocabulary.items(), key=lambda entry: rank.get(entry[1], -1)):
            if token in self.parts:
                texts[token] = texts[self.parts[token][0]] + texts[self.parts[token][1]]
            elif len(text) == 1:
                texts[token] = text
            elif text.endswith(suffix) and len(text) == 1 + len(suffix):
                texts[token] = text[0] + END
        by_text = {text: token for token, text in texts.items()}
        count = max(vocabulary.values()) + 1
        self.size, self.shorter = [0] * count, [-1] * count
        self.automaton = ahocorasick.Automaton()
        for token, text in texts.items():
            self.size[token] = len(text)
            self.automaton.add_word(text, (len(text), token))
            self.shorter[token] = next((by_text[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in by_text), -1)
        self.automaton.make_automaton()
        self._apart: dict[int, bool] = {}

    def _spine(self, token: int, side: int) -> list[int]:
        """The symbols at one edge of a token in the order in which they come to be, the token last."""
        out = [token]
        while out[-1] in self.parts:
            out.append(self.parts[out[-1]][side])
        return out[::-1]

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge ever crosses the border between ``a`` and ``b``; pairs are kept in a table."""
        known = self._apart.get(a << 32 | b)
        if known is None:
            if len(self._apart) >= REMEMBERED:
                self._apart.clear()
            known = self._apart[a << 32 | b] = self._stay_apart(self._spine(a, 1), self._spine(b, 0))
        return known

    def _stay_apart(self, left: list[int], right: list[int]) -> bool:
        i = j = 0
        while True:
            after = self.rank[left[i + 1]] if i + 1 < len(left) else _NEVER
            before = self.rank[right[j + 1]] if j + 1 < len(right) else _NEVER
            crossing = self.made.get((left[i], right[j]))
            if crossing is not None:
                k = self.rank[crossing]
                # of equal merges the one further left comes first
                if k < after and k <= before:
                    return False
            if after == before == _NEVER:
                return True
            if after <= before:
                i += 1
            else:
                j += 1

    def encode(self, word: str) -> list[int]:
        """The tokens of one word."""
        text = word + END
        longest = [-1] * (len(text) + 1)
        for end, (size, token) in self.automaton.iter(text):
            longest[end - size + 1] = token
        out: list[int] = []
        size, shorter, apart, compatible = self.size, self.shorter, self._apart, self.compatible
        dead, at, token, before, whole = bytearray(len(text) + 1), 0, longest[0], -1, len(text)
        while at < whole:
            while token >= 0:
                if not dead[at + size[token]]:
                    if before < 0:
                        break
                    fits = apart.get(before << 32 | token)
                    if fits or fits is None and compatible(before, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                before, token = token, longest[at]
            elif out:
                dead[at] = 1
                token = shorter[out.pop()]
                at -= size[before]
                before = out[-1] if out else -1
            else:
                raise ValueError("a symbol of the text is not in the vocabulary")
        return out


class WordBpe:
    """``ids`` gives what ``Tokenizer.encode(text, add_special_tokens=False)`` gives for a vocabulary of lower-case words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model["dropout"] or model["continuing_subword_prefix"] or not model["end_of_word_suffix"]:
            raise ValueError("not a vocabulary of byte pairs with word ends")
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        library = Tokenizer.from_file(path)
        self._normal, self._split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else lambda text: [text]
        self._bytes = {c: self._split(chr(c))[0][0] for c in range(0xC0, 0x100) if _PLAIN(chr(c))}
        self._words: dict[str, tuple[int, ...]] = {}

    def _word(self, word: str) -> tuple[int, ...]:
        """The ids of a word in the vocabulary's symbols."""
        found = tuple(self.merges.encode(word))
        if len(word) <= 64:
            if len(self._words) >= REMEMBERED:
                self._words.clear()
            self._words[word] = found
        return found

    def ids(self, text: str) -> list[int]:
        """The ids of a stretch of text without ASCII white space."""
        known = self._words.get
        if known(text) and text.islower() and text.isascii():
            return known(text)
        out: list[int] = []
        for part in self._cut(text) if "<" in text else (text,):
            if part in self.special:
                out.append(self.special[part])
            elif _PLAIN(part):
                part = part.lower()
                for word in (part,) if part.isalpha() else _PLAIN_SPLIT(part):
                    word = word if word.isascii() else word.translate(self._bytes)
                    out += known(word) or self._word(word)
            elif part:
                for word, _ in self._split(self._normal(part)):
                    out += known(word) or self._word(word)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's ids start (one more than texts), and all ids: nothing joins across ASCII white space."""
        words = Words(texts, lambda texts: texts)
        each = [self.ids(w) for w in words.unique]
        lengths = np.array([len(x) for x in each], np.int64)
        flat = np.array([i for x in each for i in x], np.uint32)
        own = lengths[words.codes]
        ids = flat[gather_runs((np.cumsum(lengths) - lengths)[words.codes], own)]
        return np.concatenate(([0], np.cumsum(own)))[words.starts], ids


class OffsetTable:
    """All tokens' texts in one row of bytes, and where each starts; ids no token has are passed over."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["decoder"] is not None:
            raise ValueError("decoding joins tokens by spaces, as a vocabulary without a decoder does")
        texts = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        rows = [(texts[i] + " ").encode() if i in texts else b"" for i in range(max(texts) + 1)]
        self.lengths = np.array([len(r) for r in rows] + [0], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(rows), np.uint8)

    def decode(self, starts: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The text of each row of ids: its tokens joined by spaces."""
        ids = np.minimum(ids, len(self.lengths) - 1)
        own = self.lengths[ids]
        known = np.flatnonzero(own)
        # the last token of a text takes no space along
        rank = np.searchsorted(known, starts)
        full = np.flatnonzero(np.diff(rank))
        own[known[rank[full + 1] - 1]] -= 1
        data = self.bytes[gather_runs(self.starts[ids], own)]
        return _from_rows(np.concatenate(([0], np.cumsum(own)))[starts], data, pa.large_string())


def _from_rows(offsets: np.ndarray, data: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An array whose rows are stretches of ``data``."""
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> WordBpe:
    return WordBpe(path)


@functools.lru_cache(maxsize=2)
def _table(path: str) -> OffsetTable:
    return OffsetTable(path)


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids) for every row of ``docs`` (doc_id, text); ids are little-endian unsigned 32-bit integers.

    ``path`` names a vocabulary file of byte pairs with word ends that every executor has. Each row stands for itself: rows
    that repeat an id or a text repeat their ids. A missing text, an empty one and one of white space alone have no ids;
    a missing id stays missing. Texts are encoded whole, their distinct stretches once per slice; the strings of special
    tokens are these tokens. Other columns are left out, an empty table gives no rows; nothing is shuffled.
    """

    def make():
        encoder = _encoder(path)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            starts, ids = encoder.encode(batch.column("text"))
            rows = _from_rows(starts * 4, ids.astype("<u4").view(np.uint8), pa.large_binary())
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(starts)), rows.cast(pa.binary())], ["doc_id", "n_tokens", "ids"])

        return one

    return in_slices(texts_of(docs), make, "doc_id long, n_tokens long, ids binary")


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """The columns of ``rows`` with ``text`` besides: the tokens of ``ids`` (binary, as ``encode_texts`` gives) joined by spaces.

    Ids that the vocabulary hasn't are passed over. Missing and empty ids give an empty text; a column ``text`` that is there
    already is replaced. An empty table gives no rows.
    """
    kept = [c for c in rows.columns if c != "text"]

    @tidy
    def run(batches):
        table = _table(path)
        for part in slices(batches, "ids", 1 << 20):
            size = pc.fill_null(pc.binary_length(part.column("ids")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            if (size % 4).any():
                raise ValueError("ids are four bytes each")
            data = b"".join(part.column("ids").drop_null().to_pylist())
            starts = np.concatenate(([0], np.cumsum(size // 4)))
            text = table.decode(starts, np.frombuffer(data, "<u4").astype(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [text.cast(pa.string())], [*kept, "text"])

    schema = rows.select(*kept).schema.add("text", "string")
    return rows.select(*kept).mapInArrow(run, schema)
