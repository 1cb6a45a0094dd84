from __future__ import annotations

import hashlib
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tickloom.llm import queries, word_bpe

PATH = queries.vocabulary("word_bpe_49k.json")
ODD = ["aaaa aaaaaaa aaaaaaaaaaaaa", "hello World's don't I'LL 123 a1b2 <|endoftext|>x<|startoftext|> <|END", "ÀÉ é ́ x　y ​ 漢字かな ﬀ İ ǅ ΣΑΣ",
       "\x1c\x1d a\x85b\xa0c \x00 d", "🙂🙃 !!!??? ...''' 's's", "", "   \t", "x</w> </w> l</w", "'S'T'RE", "K İ ß ŉ", "힣 각 é ́",
       "<|endoftext|><|endoftext|>", "a" * 5000, "ab" * 3000, "漢" * 3000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return word_bpe.WordBpe(PATH)


def random_texts(count: int) -> list[str]:
    draw = random.Random(5)
    kinds = [(1, 127), (1, 0x24F), (0x300, 0x36F), (1, 0x2FFF), (0x1F000, 0x1FFFF), (0x2000, 0x20FF), (97, 122), (97, 100)]
    one = lambda: chr(draw.randint(*draw.choice(kinds)))
    return ["".join(one() for _ in range(draw.randint(1, 30))) for _ in range(count)] + [
        "".join(draw.choice("abcdeinrst"[: draw.randint(1, 10)]) for _ in range(draw.randint(1, 40))) for _ in range(count)]


def test_ids_and_texts_are_the_librarys(library, own):
    texts = ODD + random_texts(1500)
    starts, ids = own.encode(pa.array(texts))
    decoded = word_bpe.OffsetTable(PATH).decode(starts, ids.astype(np.int64)).to_pylist()
    for i, text in enumerate(texts):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[starts[i] : starts[i + 1]].tolist() == want, text
        assert decoded[i] == library.decode(want, skip_special_tokens=False), text


def test_compatible_means_that_a_pair_encodes_to_itself(library, own):
    draw, merges = random.Random(2), own.merges
    texts = {i: t for t, i in library.get_vocab().items()}
    inner = [i for i in texts if not texts[i].endswith("</w>") and i < 49406]
    last = [i for i in texts if texts[i].endswith("</w>")]
    apart = 0
    for _ in range(3000):
        a, b = draw.choice(inner), draw.choice(last)
        word = texts[a] + texts[b][: -len("</w>")]
        want = [i for i in library.model.tokenize(word)]
        assert merges.compatible(a, b) == ([t.id for t in want] == [a, b])
        apart += merges.compatible(a, b)
    assert 100 < apart < 2900


def test_tables_that_forget(library, monkeypatch):
    monkeypatch.setattr(word_bpe, "REMEMBERED", 3)
    small = word_bpe.WordBpe(PATH)
    for text in ODD:
        assert small.encode(pa.array([text]))[1].tolist() == library.encode(text, add_special_tokens=False).ids


def test_time_is_linear(own):
    import time

    def seconds(n):
        begin = time.perf_counter()
        own.merges.encode("abcab" * n)
        return time.perf_counter() - begin

    seconds(1000)
    assert seconds(40_000) < 40 * max(seconds(4000), 0.01)


def brute_row(library, doc_id, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    digest = lambda data: hashlib.sha256(data).hexdigest()
    return doc_id, len(ids), digest(struct.pack(f"<{len(ids)}I", *ids)), digest(library.decode(ids, skip_special_tokens=False).encode())


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_odd_rows(spark, library, odd, odd_rows, none, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_word_bpe(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert rows_of(got) == sorted((brute_row(library, r[0], r[1]) for r in odd_rows), key=str)
    assert word_bpe.decode_ids(word_bpe.encode_texts(none, PATH), PATH).collect() == []


def test_decoding_any_rows(spark, library):
    ids = lambda *x: struct.pack(f"<{len(x)}I", *x)
    rows = [(1, ids(320, 49407, 60_000, 7), "old"), (2, None, None), (3, b"", "x"), (4, ids(60_000), None), (5, ids(512), None)]
    frame = spark.createDataFrame(rows, "k int, ids binary, text string").repartition(1)
    got = {r["k"]: r["text"] for r in word_bpe.decode_ids(frame, PATH).collect()}
    assert got == {1: library.decode([320, 49407, 60_000, 7], skip_special_tokens=False), 2: "", 3: "", 4: "", 5: library.decode([512])}


def test_whole_table(spark, library):
    sf = "/root/testdata/sf0.01"
    rows = queries.table(spark, sf, "documents").select("doc_id", "text").collect()
    assert rows_of(queries.op13_word_bpe(spark, sf)) == sorted((brute_row(library, *r) for r in rows), key=str)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        word_bpe.WordBpe(queries.vocabulary("byte_bpe_50k.json"))
    with pytest.raises(ValueError):
        word_bpe.OffsetTable(queries.vocabulary("byte_bpe_50k.json"))
