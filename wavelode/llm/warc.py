"""WARC archives with a two-level capture index.

Writing: a page is a gzipped WARC record, a ``response`` with its payload or a ``revisit`` of an equal one.
Each task writes archives of its own in the shared folder and yields where its records lie.

Index: capture lines sorted by reversed-host URL key are packed into compressed blocks, some hundred lines
each; a file of blocks ends in its sparse directory, the first key and place of every block.  The root,
one row per index file, is all that is ever collected.

Lookup: a key is found by binary search in the root, in that file's directory and in the block's lines;
then the record alone is read, by its range.  Lookups are range-sorted, so a task meets few blocks.

Names of files hold the task attempt, and the tables that lead to them are those of attempts that succeeded:
an attempt that is lost leaves files that nothing refers to.  Files are written through ``pyarrow.fs``,
so the shared folder may be local, HDFS or an object store.

Null html is the empty payload.  Null urls have the empty key, null ids are kept as null and never
revisit.  Rows that repeat the largest id of equal payloads are all responses.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from . import common

BLOCK_LINES = 256
ARCHIVE_BYTES = 128 << 20
LEVEL = 4
#: Digests with copies up to which their table is broadcast (about 40 bytes each).
BROADCAST_DIGESTS = 100_000
DATE = "2024-01-01T00:00:00Z"


def url_key(url: Column, page_id: Column) -> Column:
    """``com,example,www)/path?query`` and the id, which makes captures of one URL unlike."""
    u = F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), r"[\x00-\x20]+", "%20")
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"#.*$", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    return F.concat(key, F.lit(" "), F.lpad(F.coalesce(page_id.cast("string"), F.lit("none")), 20, "0"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse_record(data: bytes) -> dict:
    """Headers, type, payload (None for a revisit), and the digest in hex; ValueError if it does not fit the payload."""
    if not data.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    number = lambda s: None if s == "<urn:page:none>" else int(s[10:-1])
    out = {"page_id": number(fields["warc-record-id"]), "url": fields["warc-target-uri"], "record_type": fields["warc-type"], "payload_digest": digest}
    out["payload_bytes"] = int(_fields(http)["content-length"])
    if out["record_type"] == "revisit":
        return out | {"refers_to": number(fields["warc-refers-to"]), "payload": None}
    if len(payload) != out["payload_bytes"] or hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
    return out | {"refers_to": None, "payload": payload}


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _attempt() -> str:
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"{context.partitionId():06d}-{context.taskAttemptId()}"


class _Archive:
    """Appends to files ``name-k`` of a folder, a new one when the last is full."""

    def __init__(self, folder: str, name: str, suffix: str):
        self.system, self.path = fs.FileSystem.from_uri(folder)
        self.system.create_dir(self.path, recursive=True)
        self.name, self.suffix, self.k, self.out = name, suffix, -1, None
        self.at = 0

    def add(self, data: bytes) -> tuple[str, int]:
        if self.out is None or self.at >= ARCHIVE_BYTES:
            self.close()
            self.k, self.at = self.k + 1, 0
            self.file = f"{self.name}-{self.k:03d}{self.suffix}"
            self.out = self.system.open_output_stream(f"{self.path}/{self.file}", compression=None)
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return self.file, at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes ``(page_id, url, payload, digest, refers_to, key)``; the staged table ``(key, line)`` of captures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = _Archive(folder, _attempt(), ".warc.gz")
        try:
            for batch in common.slices(batches):
                lines = []
                for page_id, url, payload, digest, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    data = _gzip(record(page_id, url, payload, digest, refers_to))
                    file, at = archive.add(data)
                    lines.append(json.dumps({"id": page_id, "file": file, "offset": at, "length": len(data)}, separators=(",", ":")))
                yield pa.RecordBatch.from_arrays([batch.column(5), pa.array(lines, pa.string())], names=["key", "line"])
        finally:
            archive.close()

    return common.stage(records.select("page_id", "url", "payload", "digest", "refers_to", "key").mapInArrow(run, "key string, line string"), "warc-captures")


def write_index(captures: DataFrame, folder: str) -> list[tuple[bytes, str, int, int]]:
    """Sorts captures into blocks; returns the root: first key, file, place and size of the directory of each index file."""
    parts = common.shuffle_partitions(captures.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, directory, lines, first = None, [], [], None
        name = _attempt()

        def block() -> None:
            data = _gzip("\n".join(f"{k}\t{v}" for k, v in lines).encode())
            directory.append((lines[0][0], archive.at, len(data)))
            archive.add(data)
            lines.clear()

        for batch in batches:
            for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if archive is None:
                    archive, first = _Archive(folder, name, ".cdx"), pair[0]
                lines.append(pair)
                if len(lines) == BLOCK_LINES:
                    block()
        if archive is not None:
            if lines:
                block()
            footer = _gzip(json.dumps(directory).encode())
            place = archive.at
            file, _ = archive.add(footer)
            archive.close()
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([file]), pa.array([place], pa.int64()), pa.array([len(footer)], pa.int64())], names=["first", "file", "place", "size"])

    rows = captures.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(run, "first string, file string, place long, size long")
    root = common.stage(rows, "warc-root").collect()  # a row per index file
    return sorted((r["first"].encode(), r["file"], r["place"], r["size"]) for r in root)


class Reader:
    """Looks captures up in an index and reads their records by range."""

    def __init__(self, folder: str, root: list[tuple[bytes, str, int, int]]):
        self.system, self.path = fs.FileSystem.from_uri(folder)
        self.root = root
        self.firsts = [r[0] for r in root]
        self.open: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.directories: OrderedDict[str, tuple] = OrderedDict()
        self.block: tuple = (None, [], [])

    def read(self, file: str, at: int, size: int) -> bytes:
        if file not in self.open:
            self.open[file] = self.system.open_input_file(f"{self.path}/{file}")
            if len(self.open) > 64:
                self.open.popitem(last=False)[1].close()
        self.open.move_to_end(file)
        return self.open[file].read_at(size, at)

    def _directory(self, k: int) -> tuple[list[bytes], list]:
        _, file, place, size = self.root[k]
        if file not in self.directories:
            entries = json.loads(zlib.decompress(self.read(file, place, size), 31))
            self.directories[file] = ([e[0].encode() for e in entries], entries)
            if len(self.directories) > 8:
                self.directories.popitem(last=False)
        return self.directories[file]

    def _lines(self, k: int, b: int) -> tuple[list[bytes], list[bytes]]:
        if self.block[0] != (k, b):
            _, at, size = self._directory(k)[1][b]
            pairs = [x.partition(b"\t") for x in zlib.decompress(self.read(self.root[k][1], at, size), 31).split(b"\n")]
            self.block = ((k, b), [p[0] for p in pairs], [p[2] for p in pairs])
        return self.block[1], self.block[2]

    def captures(self, key: str) -> list[dict]:
        """All captures of a key: equal keys may reach over blocks and files."""
        wanted, found = key.encode(), []
        k = max(0, bisect_left(self.firsts, wanted) - 1)
        while k < len(self.root) and self.firsts[k] <= wanted:
            firsts, _ = self._directory(k)
            b = max(0, bisect_left(firsts, wanted) - 1)
            while b < len(firsts) and firsts[b] <= wanted:
                keys, lines = self._lines(k, b)
                found += [json.loads(x) for x in lines[bisect_left(keys, wanted) : bisect_right(keys, wanted)]]
                b += 1
            k += 1
        return found

    def fetch(self, capture: dict) -> dict:
        return parse_record(zlib.decompress(self.read(capture["file"], capture["offset"], capture["length"]), 31))

    def close(self) -> None:
        for f in self.open.values():
            f.close()


def lookup(keys: DataFrame, folder: str, root: list, with_payload: bool = False) -> DataFrame:
    """The records of every unlike key in ``key``, read back: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to``."""
    shared = keys.sparkSession.sparkContext.broadcast(root)  # a row per index file
    parts = common.shuffle_partitions(keys.sparkSession)
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last = Reader(folder, shared.value), None
        try:
            for batch in common.slices(batches):
                found = []
                for key in batch.column(0).to_pylist():
                    if key != last:
                        found += reader.captures(key)
                        last = key
                found.sort(key=lambda c: (c["file"], c["offset"]))
                rows = [reader.fetch(c) for c in found]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)
        finally:
            reader.close()

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return keys.select("key").repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(run, schema)


def archive(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[str, list]:
    """Writes archives and index of all pages; their folder and the index root."""
    spark = pages.sparkSession
    folder = common.new_path(spark, "warc")
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    page_id = F.col(id_col).cast("long")
    base = pages.select(page_id.alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"), url_key(F.col(url_col), page_id).alias("key"))
    copies = base.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "newest")
    copies = common.stage(copies, "warc-copies")
    right = F.broadcast(copies) if copies.count() <= BROADCAST_DIGESTS else copies
    # the digest alone decides: only payloads of the least size are in the right table
    records = base.join(right, "digest", "left").withColumn("refers_to", F.when(F.col("page_id") < F.col("newest"), F.col("newest")))
    captures = write_archives(records, folder)
    root = write_index(captures, folder)
    common.unstage(captures)
    common.unstage(copies)
    return folder, root


def archive_and_read(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives all pages, then looks every one up again."""
    folder, root = archive(pages, least, id_col, url_col, html_col)
    return lookup(pages.select(url_key(F.col(url_col), F.col(id_col).cast("long")).alias("key")), folder, root)


def archive_sql(least: int = 1000, table: str = "pages") -> str:
    """The verdict on every page as DuckDB SQL."""
    return f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM {table}),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
m AS (SELECT *, CASE WHEN n >= {least} THEN max(page_id) OVER (PARTITION BY h) END AS newest FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest, CASE WHEN page_id < newest THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < newest THEN newest END AS refers_to FROM m"""
