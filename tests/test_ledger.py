"""Ledgers: batches are seen whole or not at all, few folders count, repeated batches count once."""

from __future__ import annotations

import math
from pathlib import Path

import pytest
from pyarrow import fs

from tickloom.streaming import ledger


def batch(spark, rows):
    return spark.createDataFrame(rows, "key string, value bigint")


def latest(spark, path):
    return {r.key: r.value for r in ledger.read_latest(spark, path, "key").collect()}


def test_newest_row_of_each_key(spark, tmp_path):
    path, want = str(tmp_path / "t"), {}
    for n in range(20):
        rows = [(f"k{n % 3}", n), (f"own{n}", n)] + ([(None, n)] if n % 7 == 0 else [])
        ledger.commit(batch(spark, rows).coalesce(1), path, n, "key")
        want |= dict(rows)
        folders = ledger.newest(path)["folders"]
        assert len(folders) == bin(n + 1).count("1") <= math.log2(n + 1) + 1
        assert [f["first"] for f in folders][1:] == [f["last"] + 1 for f in folders][:-1]
    assert latest(spark, path) == want
    rows = ledger.read(spark, path)
    assert rows.columns == ["key", "value", "batch"] and rows.count() <= 2 * len(want)
    # only what the last entries name is left
    named = {f["name"] for n in range(12, 20) for f in ledger._read(path, f"{path}/entries/{n:020d}.json")["folders"]}
    assert {p.name for p in (tmp_path / "t" / "data").iterdir()} == named
    assert len(list((tmp_path / "t" / "entries").iterdir())) == ledger.KEPT


def test_rows_of_one_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        ledger.read_batch(spark, path, 0)
    for n in range(5):
        ledger.commit(batch(spark, [("a", n)] * (n % 3)).coalesce(1), path, n)
    for n in range(5):
        rows = ledger.read_batch(spark, path, n)
        assert rows.columns == ["key", "value"] and [tuple(r) for r in rows.collect()] == [("a", n)] * (n % 3)
    assert ledger.read_batch(spark, path, 7).count() == 0


def test_rows_without_a_key_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(9):
        ledger.commit(batch(spark, [("a", n)] * (n % 3)).coalesce(1), path, n * 10)
    rows = sorted((r.key, r.value, r.batch) for r in ledger.read(spark, path).collect())
    assert rows == sorted(("a", n, n * 10) for n in range(9) for _ in range(n % 3))


def test_large_folders_without_a_key_stay_as_they_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "SMALL", 3000)
    path = str(tmp_path / "t")
    for n in range(12):
        ledger.commit(batch(spark, [(f"{n}-{i}", i) for i in range(300 if n % 4 == 1 else 1)]).coalesce(1), path, n)
    folders = ledger.newest(path)["folders"]
    assert ledger.read(spark, path).count() == 3 * 300 + 9
    assert 3 < len(folders) < 12 and [f["name"] for f in folders if f["bytes"] > 3000] == [f["name"] for f in folders if f["first"] == f["last"] and f["first"] % 4 == 1]


def test_repeated_batches_change_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    ledger.commit(batch(spark, [("a", 1)]), path, 3, "key")
    ledger.commit(batch(spark, [("a", 2), ("b", 2)]), path, 3, "key")
    ledger.commit(batch(spark, [("c", 2)]), path, 2, "key")
    assert latest(spark, path) == {"a": 1} and ledger.committed(path, 3) and not ledger.committed(path, 4)


def test_no_batches(spark, tmp_path):
    path = str(tmp_path / "none")
    assert ledger.newest(path) is None and not ledger.committed(path, 0)
    empty = ledger.read(spark, path, "key string, value bigint")
    assert empty.columns == ["key", "value", "batch"] and empty.count() == 0
    with pytest.raises(FileNotFoundError):
        ledger.read(spark, path)


class OnlyFilesMove(fs.FileSystemHandler):
    """A local store that, like an object store, cannot move folders, and that can be stopped before an entry gets its name."""

    def __init__(self):
        self.local, self.stopped = fs.LocalFileSystem(), False

    def move(self, src, dest):
        assert Path(src).is_file(), "a folder was moved"
        if self.stopped:
            raise OSError("stopped")
        self.local.move(src, dest)

    def get_type_name(self):
        return "only-files-move"

    def normalize_path(self, path):
        return path

    def get_file_info(self, paths):
        return self.local.get_file_info(paths)

    def get_file_info_selector(self, selector):
        return self.local.get_file_info(selector)

    def create_dir(self, path, recursive):
        self.local.create_dir(path, recursive=recursive)

    def delete_dir(self, path):
        self.local.delete_dir(path)

    def delete_dir_contents(self, path, missing_dir_ok=False):
        self.local.delete_dir_contents(path, missing_dir_ok=missing_dir_ok)

    def delete_root_dir_contents(self):
        raise NotImplementedError

    def delete_file(self, path):
        self.local.delete_file(path)

    def copy_file(self, src, dest):
        self.local.copy_file(src, dest)

    def open_input_stream(self, path):
        return self.local.open_input_stream(path)

    def open_input_file(self, path):
        return self.local.open_input_file(path)

    def open_output_stream(self, path, metadata):
        return self.local.open_output_stream(path)

    def open_append_stream(self, path, metadata):
        raise NotImplementedError


def test_half_written_batches_are_not_read(spark, tmp_path, monkeypatch):
    store, path = OnlyFilesMove(), str(tmp_path / "t")
    monkeypatch.setattr(ledger, "file_system", lambda uri: (fs.PyFileSystem(store), uri))
    for n in range(3):
        ledger.commit(batch(spark, [("a", n), (f"k{n}", n)]).coalesce(1), path, n, "key")
    before = latest(spark, path)
    store.stopped = True
    with pytest.raises(OSError):
        ledger.commit(batch(spark, [("a", 99), ("z", 99)]).coalesce(1), path, 3, "key")
    (tmp_path / "t" / "data" / "3-half").mkdir()
    (tmp_path / "t" / "data" / "3-half" / "part-0.parquet").write_bytes(b"half")
    assert latest(spark, path) == before and not ledger.committed(path, 3)
    # the batch is tried again
    store.stopped = False
    for n in range(3, 14):
        ledger.commit(batch(spark, [("a", n)]).coalesce(1), path, n, "key")
    assert latest(spark, path) == {**before, "a": 13}
    assert not (tmp_path / "t" / "data" / "3-half").exists()
