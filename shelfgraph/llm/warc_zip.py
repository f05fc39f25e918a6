"""WARC records in ZIP packages, and a reader that fetches records by byte range without unpacking.

A package has the stored members ``archive/data.warc.gz`` (each record its own gzip member) and ``indexes/index.cdxj`` (a
line for each record: offset and length inside the archive). The reader takes the end record from the file's tail, follows the
ZIP64 locator where there is one, parses the central directory, and turns a record's place in a stored member into a range
of the file. Neighbouring ranges are fetched in one read of bounded size.

Equal payloads of at least ``min_bytes`` are written once, by the record with the smallest id; the others become revisits.
The search for them moves digests only, never payloads.

Defined results: a null payload is empty. Null ids rank below all others, and a null id stays null. Rows equal in id and payload are all
responses. Line breaks in a URL are percent-coded. An empty table gives no packages and an empty result. Extra columns
are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import zipfile
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgraph.llm.storage import open_store, shared_folder, unique_name
from shelfgraph.session import staged

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES = 48 << 20
READ_BYTES = 4 << 20
_END, _LOCATOR, _END64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"


class Member(NamedTuple):
    name: str
    method: int
    size: int        # of the stored bytes
    header: int      # where the local header begins


class ZipReader:
    """The directory of a ZIP file, and ranges of its stored members. ``file`` has size(), seek() and read()."""

    def __init__(self, file):
        self.file = file
        self.members = {m.name: m for m in self._entries(*self._directory())}
        self._begin: dict[str, int] = {}

    def _at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def _directory(self) -> tuple[int, int, int]:
        """Offset and size of the central directory, and its number of entries."""
        total = self.file.size()
        tail_at = max(0, total - 65_557)
        tail = self._at(tail_at, total - tail_at)
        at = len(tail)
        while True:
            at = tail.rfind(_END, 0, at)
            if at < 0:
                raise ValueError("no end of central directory")
            if len(tail) - at >= 22 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
                break
        count, size, offset = struct.unpack_from("<HII", tail, at + 10)
        locator = self._at(tail_at + at - 20, 20) if tail_at + at >= 20 else b""
        if locator[:4] == _LOCATOR:
            end64 = self._at(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != _END64:
                raise ValueError("ZIP64 end record not found")
            count, size, offset = struct.unpack_from("<QQQ", end64, 32)
        return offset, size, count

    def _entries(self, offset: int, size: int, count: int) -> Iterator[Member]:
        raw, at = self._at(offset, size), 0
        for _ in range(count):
            if raw[at:at + 4] != _ENTRY:
                raise ValueError("damaged central directory")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            stored, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", raw, at + 20)
            header = struct.unpack_from("<I", raw, at + 42)[0]
            name = raw[at + 46:at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = raw[at + 46 + n_name:at + 46 + n_name + n_extra]
            k = 0
            while k + 4 <= len(extra):
                tag, n = struct.unpack_from("<HH", extra, k)
                if tag == 1:  # only the fields that do not fit their 32 bits, in this order
                    place = k + 4
                    for field in ("plain", "stored", "header"):
                        if {"plain": plain, "stored": stored, "header": header}[field] == 0xFFFFFFFF:
                            wide = struct.unpack_from("<Q", extra, place)[0]
                            place += 8
                            plain, stored, header = (wide if field == f else v for f, v in (("plain", plain), ("stored", stored), ("header", header)))
                k += 4 + n
            yield Member(name, method, stored, header)
            at += 46 + n_name + n_extra + n_note

    def read(self, name: str, start: int = 0, n: int | None = None) -> bytes:
        """``n`` bytes of a stored member from ``start`` on."""
        member = self.members[name]
        if member.method:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        if name not in self._begin:
            local = self._at(member.header, 30)
            if local[:4] != _LOCAL:
                raise ValueError("damaged local header")
            self._begin[name] = member.header + 30 + sum(struct.unpack_from("<HH", local, 26))
        n = member.size - start if n is None else min(n, member.size - start)
        return self._at(self._begin[name] + start, n)

    def pieces(self, name: str, ranges: list[tuple[int, int]], most: int = READ_BYTES) -> Iterator[bytes]:
        """The bytes of (offset, length) ranges in ascending order; neighbours share one read."""
        i = 0
        while i < len(ranges):
            first, j = ranges[i][0], i + 1
            while j < len(ranges) and sum(ranges[j]) - first <= most:
                j += 1
            raw = memoryview(self.read(name, first, sum(ranges[j - 1]) - first))
            for offset, n in ranges[i:j]:
                yield bytes(raw[offset - first:offset - first + n])
            i = j


def _clean(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit keeps the HTTP header (with the payload's length) and no payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields, payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


class PackageWriter:
    """A ZIP package written as a stream: the archive member grows, the index member follows."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self.out = store.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member, self.size, self.lines = self.zip.open(ARCHIVE, "w", force_zip64=True), 0, []

    def add(self, key: str, record: bytes) -> None:
        packed = gzip.compress(record, 6, mtime=0)
        self.member.write(packed)
        self.lines.append(json.dumps({"key": key, "offset": self.size, "length": len(packed)}))
        self.size += len(packed)

    def close(self) -> int:
        self.member.close()
        self.zip.writestr(INDEX, "\n".join(self.lines))
        self.zip.close()
        self.out.close()
        return len(self.lines)


def revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 100) -> DataFrame:
    """(id, digest, refers_to) of the rows whose payload a row with a smaller id has."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).alias("n"))
    rows = staged(rows.filter(F.col("n") >= min_bytes).drop("n"), "payload-digests")
    first = rows.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count("*").alias("n"), F.bool_or(F.col("id").isNull()).alias("null_id"))
    first = first.filter("n > 1").select(F.col("digest").alias("d"), F.when(~F.col("null_id"), F.col("refers_to")).alias("refers_to"))
    return rows.join(first, F.col("digest") == F.col("d")).filter(~F.col("id").eqNullSafe(F.col("refers_to"))).select("id", "digest", "refers_to").distinct()


def _writer(folder: str, package_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, files, package, uri = TaskContext.get().partitionId(), 0, None, ""
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        for batch in batches:
            for page_id, url, html, refers_to, revisit in zip(*(batch.column(i) for i in range(5)), strict=True):
                payload = (html.as_py() or "").encode()
                if package is None:
                    uri = f"{folder}/{unique_name(f'{task:06d}-{files:06d}', '.zip')}"
                    package, files = PackageWriter(uri), files + 1
                key = page_id.as_py()
                package.add(str(key), record_bytes(key, url.as_py(), payload, hashlib.sha256(payload).hexdigest(), len(payload), refers_to.as_py(), revisit.as_py()))
                if package.size >= package_bytes:
                    yield pa.record_batch([pa.array([uri]), pa.array([package.close()], pa.int64())], ["uri", "n_records"])
                    package = None
        if package is not None:
            yield pa.record_batch([pa.array([uri]), pa.array([package.close()], pa.int64())], ["uri", "n_records"])

    return run


def write_packages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None,
                   min_bytes: int = 100, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write all pages when called; the manifest: (uri, n_records)."""
    folder = folder or shared_folder(pages.sparkSession, "warc-packages")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("string").alias("payload"))
    again = revisits(pages, id_col, payload_col, min_bytes).select(F.col("id").alias("i"), F.col("digest").alias("d"), "refers_to", F.lit(True).alias("again"))
    digest = F.sha2(F.coalesce(F.col("payload"), F.lit("")).cast("binary"), 256)
    known = rows.withColumn("digest", digest).join(again, F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left")
    known = known.select("id", "url", "payload", "refers_to", F.coalesce("again", F.lit(False)).alias("again"))
    return staged(known.mapInArrow(_writer(folder, package_bytes), "uri string, n_records long"), "manifest")


def _page(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.string()), ("payload_bytes", pa.int64()),
                     ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_package(uri: str) -> Iterator[tuple]:
    """The records of a package in the order of its index."""
    store, path = open_store(uri)
    with store.open_input_file(path) as file:
        package = ZipReader(file)
        index = package.read(INDEX).decode()
        ranges = [(x["offset"], x["length"]) for x in map(json.loads, index.split("\n") if index else [])]
        for raw in package.pieces(ARCHIVE, ranges):
            fields, http, payload = parse_record(gzip.decompress(raw))
            kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
            if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"{uri}: payload of {fields['WARC-Record-ID']} is damaged")
            size = int(http["Content-Length"]) if kind == "revisit" else len(payload)
            refers = _page(fields["WARC-Refers-To"]) if kind == "revisit" else None
            yield _page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), payload.decode() if kind == "response" else None, size, digest, kind, refers


def _reader(columns: list[str]):
    wanted = [_SCHEMA.get_field_index(c) for c in columns]
    schema = pa.schema([_SCHEMA.field(i) for i in wanted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                held: list[tuple] = []
                for row in read_package(uri):
                    held.append(tuple(row[i] for i in wanted))
                    if len(held) == 500:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
                        held = []
                if held:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)

    return run, ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in schema)


def read_records(manifest: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The records of all packages: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    run, schema = _reader(columns or _SCHEMA.names)
    return manifest.select("uri").repartition("uri").mapInArrow(run, schema)
