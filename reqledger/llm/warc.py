"""WARC archives with a two-level capture index.

Writing: payload digests are compared with a grouped aggregate; of equal payloads of at least min_bytes the largest page id is the response
and the others are revisit records, which carry its headers but no payload. Tasks write gzip members, one a record, to rolling archive files in the
shared folder, under names that no other attempt uses; the capture rows that a task returns name what counts.

Index: captures are range-partitioned and sorted by key (host labels reversed, then path, then capture id). Each partition writes a file of
compressed blocks of BLOCK_LINES captures, closed by a sparse directory of the blocks' first keys and places. A lookup binary-searches the files' first keys (one for each
index partition), then the file's directory, reads that one block by its range, and binary-searches its lines; then records are read by their ranges, in the order of the archives.

Null html is an empty payload; a null url has an empty host and path; a null page id makes a response of its own; rows equal in id and payload are all
responses when theirs is the largest id, else all revisits. An empty table writes no archive and gives no rows."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, new_folder, small_batches, table

ARCHIVE_BYTES, BLOCK_LINES, MIN_BYTES = 64 << 20, 1000, 0
DATE = "2024-01-01T00:00:00Z"
CAPTURE = "key string, page_id long, archive string, offset long, length long"


def url_key(url: str | None) -> str:
    """Scheme and fragment go; host labels are reversed: https://a.example.com/x?y#z is com,example,a)/x?y."""
    try:
        parts = urlsplit(url or "")
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return f")/{url}"
    at = f":{port}" if port and port not in (80, 443) else ""
    return f"{','.join(reversed(host.split('.')))}{at}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def capture_key(url: str | None, page_id: int | None) -> str:
    return f"{url_key(url)} {'-' if page_id is None else f'{page_id + (1 << 63):020d}'}".replace("\n", "%0A").replace("\t", "%09").replace("\r", "%0D")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: object) -> str:
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, sha1: str) -> bytes:
    """One gzip member with a response or revisit record; the HTTP header keeps the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind, body = ("response", http + payload) if refers_to is None else ("revisit", http)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {_line(url or '')}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> dict:
    """Fields of a record: page_id, kind, url, payload (None for a revisit), payload_bytes, payload_digest, refers_to."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    name = lambda x: None if x in (None, "<urn:page:None>") else int(x[10:-1])
    kind, told = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest(payload) != told):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"page_id": name(fields["WARC-Record-ID"]), "record_type": kind, "url": fields["WARC-Target-URI"], "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": told, "refers_to": name(fields.get("WARC-Refers-To"))}


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records to archives in the folder; returns their captures (a written table)."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    told = materialize(rows.select("page_id", F.sha1("html").alias("sha"), F.octet_length("html").alias("size")).filter(f"page_id is not null and size >= {min_bytes}"), "digests")
    first = materialize(told.groupBy("sha", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1"), "responses")
    again = told.join(first, ["sha", "size"]).filter("page_id < refers_to").select("page_id", F.col("sha").alias("again"), "refers_to").distinct()
    again = materialize(again, "revisits")
    marked = rows.withColumn("sha", F.sha1("html")).join(again, "page_id", "left") if again.groupBy("page_id").count().filter("count > 1").isEmpty() else rows.withColumn("sha", F.sha1("html")).join(again.withColumn("sha", F.col("again")), ["page_id", "sha"], "left")
    marked = marked.select("page_id", "url", "html", F.when(F.col("again") == F.col("sha"), F.col("refers_to")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        out, name, at = None, "", 0
        try:
            for got in batches:
                rows = []
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in got.columns), strict=True):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                    payload = html.encode()
                    member = record(page_id, url, payload, refers_to, digest(payload))
                    out.write(member)
                    rows.append((capture_key(url, page_id), page_id, name, at, len(member)))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "archive", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    _files(folder)[0].create_dir(_files(folder)[1], recursive=True)
    return materialize(marked.mapInArrow(_nonempty(run), CAPTURE), "captures")


def _nonempty(run):
    """Leave out batches without rows."""

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (b for b in run(b for b in batches if len(b)) if len(b))

    return only


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the index; returns one row for each of its files: first key and name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        name, out, at, places, lines, top = f"captures-{uuid.uuid4().hex}.idx", None, 0, [], [], None

        def block() -> None:
            nonlocal at, lines
            data = zlib.compress("\n".join(lines).encode(), 6)
            places.append((lines[0].split("\t", 1)[0], at, len(data)))
            out.write(data)
            at, lines = at + len(data), []

        for got in batches:
            if out is None:
                out = files.open_output_stream(f"{root}/{name}", compression=None)
                top = got.column(0)[0].as_py()
            for row in zip(*(c.to_pylist() for c in got.columns), strict=True):
                lines.append("\t".join(map(str, row)))
                if len(lines) == block_lines:
                    block()
        if out is not None:
            if lines:
                block()
            directory = zlib.compress(json.dumps(places).encode(), 6)
            out.write(directory + struct.pack("<Q", len(directory)))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([top]), pa.array([name])], names=["first_key", "file"])

    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(parts, "key").sortWithinPartitions("key").select("key", "archive", "offset", "length")
    return materialize(ordered.mapInArrow(_nonempty(run), "first_key string, file string"), "index")


class Index:
    """Lookups in the index files, for one task: keeps the directories it has read, and the last block."""

    def __init__(self, folder: str, tops: list[tuple[str, str]]):
        (self.files, self.root), self.tops = _files(folder), tops
        self.first, self.directories, self.last = [k for k, _ in tops], {}, (None, [])

    def _read(self, name: str, at: int, size: int) -> bytes:
        with self.files.open_input_file(f"{self.root}/{name}") as f:
            return f.read_at(size, at)

    def directory(self, name: str) -> list:
        if name not in self.directories:
            size = self.files.get_file_info(f"{self.root}/{name}").size
            (length,) = struct.unpack("<Q", self._read(name, size - 8, 8))
            places = json.loads(zlib.decompress(self._read(name, size - 8 - length, length)))
            self.directories[name] = ([p[0] for p in places], places)
        return self.directories[name]

    def block(self, name: str, number: int) -> list[str]:
        if self.last[0] != (name, number):
            _, at, size = self.directory(name)[1][number]
            self.last = ((name, number), zlib.decompress(self._read(name, at, size)).decode().split("\n"))
        return self.last[1]

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """Archive, offset and length of every capture with the key; equal keys may run over blocks and files."""
        part = max(0, bisect_left(self.first, key) - 1)
        while part < len(self.tops) and (self.first[part] <= key):
            name = self.tops[part][1]
            firsts, places = self.directory(name)
            number = max(0, bisect_left(firsts, key) - 1)
            while number < len(places) and firsts[number] <= key:
                lines = self.block(name, number)
                for line in lines[bisect_left(lines, key + "\t") : bisect_right(lines, key + "\t\U0010ffff")]:
                    _, archive, offset, length = line.split("\t")
                    yield archive, int(offset), int(length)
                number += 1
            part += 1


def lookup(index: DataFrame, folder: str, wanted: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, archive, offset and length of the captures of wanted(url, page_id). The driver holds one short row for each index file (at most spark.sql.shuffle.partitions)."""
    tops = sorted((r["first_key"], r["file"]) for r in index.collect())
    shared = wanted.sparkSession.sparkContext.broadcast(tops)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Index(folder, shared.value) if shared.value else None
        for got in batches:
            keys = sorted((capture_key(u, p), p) for p, u in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
            rows = [(p, *place) for key, p in keys if found for place in found.find(key)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["page_id", "archive", "offset", "length"])

    asked = wanted.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).distinct()
    # Near the keys' order, so that a task meets few blocks.
    asked = asked.repartitionByRange(int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.reverse(F.get(F.split(F.col("url"), "/"), 2)), "url", "page_id").sortWithinPartitions("url", "page_id")
    return asked.mapInArrow(run, "page_id long, archive string, offset long, length long")


def read_records(places: DataFrame, folder: str) -> DataFrame:
    """The records at (archive, offset, length), read by range in the archives' order."""
    schema = "page_id long, record_type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        name, source = None, None
        for got in batches:
            rows = []
            for archive, offset, length in zip(*(c.to_pylist() for c in got.columns), strict=True):
                if archive != name:
                    name, source = archive, files.open_input_file(f"{root}/{archive}")
                rows.append(parse(source.read_at(length, offset)))
            names = ["page_id", "record_type", "url", "payload", "payload_bytes", "payload_digest", "refers_to"]
            for at in range(0, len(rows), 200):
                part = rows[at : at + 200]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in part], k) for n, k in zip(names, kinds, strict=True)], names=names)

    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = places.select("archive", "offset", "length").repartitionByRange(parts, "archive", "offset").sortWithinPartitions("archive", "offset")
    return near.mapInArrow(_nonempty(run), schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = table(spark, sf_dir, "pages"), new_folder(spark, "warc")
    captures = write_archives(pages, folder)
    index = write_index(captures, folder)
    places = materialize(lookup(index, folder, pages), "places")
    return read_records(places, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
