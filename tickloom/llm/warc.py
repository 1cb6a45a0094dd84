"""WARC archives and their two-level capture index.

``write_archives`` writes a record per page; pages with equal large payloads are stored once and revisited by
the others. ``write_index`` sorts the captures by reversed-host URL key into compressed blocks of lines, one file per range of
keys, and keeps a sparse directory: the first key and place of each block beside each file, and the first key of each
file. ``look_up`` finds captures by binary search in the files' first keys, then in a file's directory, then
in the one or two blocks that may hold the key; ``read_records`` reads records by their ranges.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import cut, tidy
from tickloom.sources.logs import file_system

# Payloads of fewer bytes are stored again rather than revisited.
LEAST_SHARED = 1000
BLOCK_LINES = 1000
# The pages table holds no capture times.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, page_id long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """The host's labels from the last to the first, then the path and query; the scheme, user, default port and fragment go.

    A text that is no URL is its own key, a missing one the empty key. No key holds a line end or a blank.
    """
    text = url or ""
    try:
        parts = urlsplit(text.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        host, port = "", None
    if host:
        # an address stays as it is
        name = host if re.fullmatch(r"[0-9.]+|.*:.*", host) else ",".join(reversed(host.rstrip(".").split(".")))
        text = name + (f":{port}" if port not in (None, 80, 443) else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def capture_key(url: str | None, page_id: int | None) -> str:
    """URL key and capture, in the order of the index."""
    return f"{url_key(url)} {'-' if page_id is None else f'{page_id:020d}'}"


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page}>"), ("WARC-Date", DATE),
               ("WARC-Target-URI", re.sub(r"[\x00-\x1f\x7f]", "", url or "")), ("WARC-Payload-Digest", f"sha1:{digest}"),
               ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
        payload = b""
    return _member(headers, http + payload)


def _create(folder: str, kind: str, end: str):
    task = TaskContext.get()
    path = f"{folder}/{kind}-{task.partitionId():06d}-{task.taskAttemptId()}{end}"
    fs, local = file_system(path)
    fs.create_dir(local.rsplit("/", 1)[0], recursive=True)
    return path, fs.open_output_stream(local, compression=None)


def write_archives(pages: DataFrame, folder: str, least_shared: int = LEAST_SHARED) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) to gzip-per-record archives in ``folder``; returns their captures
    (key, page_id, file, offset, length).

    The payload is the html in UTF-8, empty where it is missing. Of rows with equal payloads of at least ``least_shared`` bytes, that with
    the largest page_id is a response and the others revisit it; rows that repeat that id are responses too, and where no row has
    an id all are. A null id is written as such. An empty table writes nothing; other columns are ignored. Files of lost or
    repeated tasks are not listed.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= least_shared
    shared = rows.filter(large).groupBy("digest").agg(F.max("page_id").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(cut(shared.select("digest", "leader")), "digest", "left")
    refers = F.when(large & F.col("leader").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("leader")), F.col("leader"))
    rows = rows.select("page_id", "url", "payload", refers.alias("refers_to"))

    @tidy
    def run(batches):
        path = out = None
        at = 0
        for batch in batches:
            found = []
            for page, url, payload, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to"))):
                if out is None:
                    path, out = _create(folder, "pages", ".warc.gz")
                    info = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{path.rsplit('/', 1)[1]}>"), ("WARC-Date", DATE),
                                    ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    at = len(info)
                page, url = page.as_py(), url.as_py()
                record = _record(page, url, payload.as_py(), refers_to.as_py())
                out.write(record)
                found.append((capture_key(url, page), page, path, at, len(record)))
                at += len(record)
            if found:
                yield _captures(found)
        if out is not None:
            out.close()

    return cut(rows.mapInArrow(run, CAPTURE))


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["key", "page_id", "file", "offset", "length"])


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes the index of ``captures`` to ``folder``; returns (first, last, file), a row per index file.

    Files hold disjoint ranges of keys, or equal keys at their ends. A file is a run of zlib-compressed blocks of ``block_lines`` sorted
    lines "key json", and beside it lies the directory of its blocks: first key, offset and length of each, as JSON.
    """

    @tidy
    def run(batches):
        path = out = first = last = None
        directory, lines, at = [], [], 0

        def flush():
            nonlocal lines, at
            block = zlib.compress("\n".join(lines).encode())
            out.write(block)
            directory.append([_key_of(lines[0]), at, len(block)])
            at += len(block)
            lines = []

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path, out = _create(folder, "index", ".cdx")
                    first = row["key"]
                last = row["key"]
                lines.append(f"{row['key']} {json.dumps([row['page_id'], row['file'], row['offset'], row['length']])}")
                if len(lines) == block_lines:
                    flush()
        if out is not None:
            if lines:
                flush()
            out.close()
            fs, local = file_system(path + ".dir")
            with fs.open_output_stream(local) as beside:
                beside.write(json.dumps(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([last]), pa.array([path])], ["first", "last", "file"])

    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(parts, "key").sortWithinPartitions("key")
    return cut(ordered.mapInArrow(run, "first string, last string, file string"))


def _key_of(line: str) -> str:
    """URL key and capture of an index line."""
    return " ".join(line.split(" ", 2)[:2])


class _IndexFile:
    """One index file, opened by a task that looks keys up in it."""

    def __init__(self, path: str):
        fs, local = file_system(path)
        with fs.open_input_stream(local + ".dir") as f:
            self.directory = json.loads(f.read())
        self.firsts = [d[0] for d in self.directory]
        self.file = fs.open_input_file(local)
        self.held: tuple[int, list[str], list[str]] = (-1, [], [])

    def block(self, k: int) -> tuple[list[str], list[str]]:
        if self.held[0] != k:
            _, at, size = self.directory[k]
            lines = zlib.decompress(self.file.read_at(size, at)).decode().split("\n")
            self.held = (k, [_key_of(x) for x in lines], lines)
        return self.held[1:]

    def find(self, key: str) -> Iterator[list]:
        # equal keys may begin in the block before the first block that starts with the key
        k = max(bisect.bisect_left(self.firsts, key) - 1, 0)
        while k < len(self.firsts) and self.firsts[k] <= key:
            keys, lines = self.block(k)
            i = bisect.bisect_left(keys, key)
            while i < len(keys) and keys[i] == key:
                yield json.loads(lines[i].split(" ", 2)[2])
                i += 1
            k += 1


def look_up(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, page_id, file, offset, length) of all captures whose key ``wanted`` (key) has; keys that repeat are looked up once.

    ``index`` is what ``write_index`` returned: a row per file, of which there are as many as shuffle partitions.
    """
    files = sorted((r["first"], r["last"], r["file"]) for r in index.collect())
    firsts = [f[0] for f in files]

    @tidy
    def place(batches):
        for batch in batches:
            keys, places = [], []
            for key in batch.column("key").to_pylist():
                k = max(bisect.bisect_left(firsts, key) - 1, 0)
                while k < len(files) and files[k][0] <= key:
                    if key <= files[k][1]:
                        keys.append(key)
                        places.append(files[k][2])
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.string()), pa.array(keys, pa.string())], ["index_file", "key"])

    @tidy
    def run(batches):
        path = opened = None
        for batch in batches:
            found = []
            for at, key in zip(batch.column("index_file").to_pylist(), batch.column("key").to_pylist()):
                if at != path:
                    path, opened = at, _IndexFile(at)
                found += [(key, *row) for row in opened.find(key)]
            if found:
                yield _captures(found)

    parts = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = wanted.select("key").filter("key IS NOT NULL").distinct().mapInArrow(place, "index_file string, key string")
    return placed.repartitionByRange(parts, "index_file", "key").sortWithinPartitions("index_file", "key").mapInArrow(run, CAPTURE)


def _parse(member: bytes) -> dict:
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda name: (None if (m := fields[name][10:-1]) == "None" else int(m)) if name in fields else None
    stated = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    if fields["WARC-Type"] == "revisit":
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        return {"page_id": page("WARC-Record-ID"), "payload_bytes": size, "payload_digest": stated, "record_type": "revisit",
                "refers_to": page("WARC-Refers-To"), "payload": None}
    found = hashlib.sha1(payload).hexdigest()
    if found != stated:
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    return {"page_id": page("WARC-Record-ID"), "payload_bytes": len(payload), "payload_digest": found, "record_type": "response",
            "refers_to": None, "payload": payload}


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(captures: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of ``captures`` (file, offset, length), read by range: page_id, payload_bytes, payload_digest (lower-case hexadecimal
    SHA-1), record_type, refers_to and, if asked for, the payload (null for revisits). Size and digest are those of the full payload; a response
    whose payload does not fit its digest raises an error.
    """
    names = [f.split(" ")[0] for f in RECORD.split(", ")] + ["payload"] * payloads
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]

    @tidy
    def run(batches):
        path = opened = None
        for batch in batches:
            found = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file != path:
                    fs, local = file_system(file)
                    path, opened = file, fs.open_input_file(local)
                found.append(_parse(opened.read_at(length, offset)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in zip(names, kinds)], names)

    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, RECORD + ", payload binary" * payloads)


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages`` and their index below ``folder``, looks every page up in the index and reads its record back."""
    captures = write_archives(pages, f"{folder}/archives")
    index = write_index(captures, f"{folder}/index")
    return read_records(look_up(index, captures.select("key")))
