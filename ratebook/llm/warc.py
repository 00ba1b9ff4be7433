"""WARC archives as a chunked record table.

A payload never has to be one value: it is rows (record, chunk number, bytes) of at most ``CHUNK`` bytes, each with the
SHA-1 of the payload up to its end, so that the last chunk of a record carries the digest of the whole.  Writers take
such rows and append them to gzip members record by record; readers stream an archive and give the rows back.

Records: ``response`` with the payload, or ``revisit`` (no payload) that names the response with the same payload.  Each
record is a gzip member of its own, as the format asks for.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import bounded_batches
from .work import by_batch, staged

CHUNK = 1 << 20
#: An archive is closed when it has passed this size.
ARCHIVE_BYTES = 256 << 20
READ = 1 << 16
CHUNK_SCHEMA = "page_id long, url string, chunk int, last boolean, digest string, size long, type string, refers_to long, data binary"
_CHUNK_FIELDS = [
    ("page_id", pa.int64()),
    ("url", pa.string()),
    ("chunk", pa.int32()),
    ("last", pa.bool_()),
    ("digest", pa.string()),
    ("size", pa.int64()),
    ("type", pa.string()),
    ("refers_to", pa.int64()),
    ("data", pa.binary()),
]


def _files(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunks(page_id: int, url: str | None, payload: memoryview, size: int = CHUNK) -> Iterator[tuple]:
    """Rows of one payload; an empty payload has one empty chunk.  ``digest`` is that of all bytes so far."""
    sha, total = hashlib.sha1(), len(payload)
    for number, at in enumerate(range(0, max(total, 1), size)):
        part = payload[at : at + size]
        sha.update(part)
        yield page_id, url, number, at + size >= total, base32(sha.digest()), min(at + size, total), "response", None, part


def _batch(rows: list[tuple], with_data: bool = True) -> pa.RecordBatch:
    fields = _CHUNK_FIELDS if with_data else _CHUNK_FIELDS[:-1]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_CHUNK_FIELDS)
    arrays = [pa.array([bytes(x) for x in c] if n == "data" else c, t) for c, (n, t) in zip(columns, fields, strict=False)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


def _digests(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    payloads = batch.column(1).cast(pa.binary())
    found = [hashlib.sha1(x.as_buffer() if x.is_valid else b"") for x in payloads]
    sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in payloads]
    yield pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array([x.digest() for x in found]), pa.array(sizes, pa.int64())], names=["page_id", "sha", "size"]
    )


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, refers_to) of pages whose payload a page of larger id has too; ``pages`` is (page_id, payload)."""
    found = staged(by_batch(pages, _digests, "page_id long, sha binary, size long"), "digests").filter(F.col("size") >= min_bytes)
    groups = found.groupBy("sha", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    groups = staged(groups, "copies")  # a plain table, so that hot payloads are split in the join
    return found.join(groups, ["sha", "size"]).filter("page_id <> refers_to").select("page_id", "refers_to").distinct()


class _Archive:
    """Writes records to gzip members; memory holds one chunk at a time."""

    def __init__(self, files: pafs.FileSystem, path: str):
        self.path, self.records, self.bytes = path, 0, 0
        self.out = files.open_output_stream(path, compression=None)

    def record(self, head: list[tuple[str, object]], payload: Iterator[memoryview], size: int) -> None:
        lines = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), *head, ("Content-Length", size)]
        text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        self._put(packer.compress(text.encode()))
        for part in payload:
            self._put(packer.compress(part))
        self._put(packer.compress(b"\r\n\r\n") + packer.flush())
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.bytes += len(data)
        self.out.write(data)

    def close(self) -> pa.RecordBatch:
        self.out.close()
        row = [[self.path.rsplit("/", 1)[1]], [self.records], [self.bytes]]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(row, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["name", "records", "bytes"]
        )


def _header(page_id: int, url: str | None, kind: str, digest: str, size: int, refers_to: int | None) -> list[tuple[str, object]]:
    head = [("WARC-Type", kind), ("WARC-Page-ID", page_id), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        # a line break in an address would end the header line
        head.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")))
    if kind == "revisit":
        head += [("WARC-Refers-To-Page", refers_to), ("WARC-Payload-Length", size)]
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    return [*head, ("Content-Type", "text/html; charset=utf-8"), ("WARC-Payload-Digest", f"sha1:{digest}")]


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, root = _files(folder)
    archive = None
    for batch in batches:
        payloads = batch.column(2).cast(pa.binary())
        for k, page_id in enumerate(batch.column(0).to_pylist()):
            if archive is None:
                archive = _Archive(files, posixpath.join(root, f"pages-{uuid.uuid4().hex}.warc.gz"))
            payload = memoryview(payloads[k].as_buffer() if payloads[k].is_valid else b"")
            url, target = batch.column(1)[k].as_py(), batch.column(3)[k].as_py()
            sha = hashlib.sha1()
            for at in range(0, len(payload), CHUNK):
                sha.update(payload[at : at + CHUNK])
            kind = "response" if target is None else "revisit"
            head = _header(page_id, url, kind, base32(sha.digest()), len(payload), target)
            body = payload if kind == "response" else payload[:0]
            archive.record(head, (body[at : at + CHUNK] for at in range(0, len(body), CHUNK)), len(body))
            if archive.bytes >= ARCHIVE_BYTES:
                yield archive.close()
                archive = None
    if archive is not None:
        yield archive.close()


def write_archives(
    pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload: str = "html", min_bytes: int = 0
) -> DataFrame:
    """Write a record per row below ``folder`` (shared by all executors); returns the written list (name, records, bytes).

    Null payloads are empty.  Of equal payloads of at least ``min_bytes`` that of the largest id is the response.  Rows
    without an id are left out; rows that repeat an id are records of their own, without revisiting each other.
    """
    bounded_batches(pages.sparkSession, rows=256)
    files, root = _files(folder)
    files.create_dir(root, recursive=True)
    plain = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), F.col(payload).alias("payload"))
    plain = plain.filter("page_id is not null")
    again = staged(revisits(plain.select("page_id", "payload"), min_bytes), "revisits")
    # few revisits are sent to the pages; beyond 100,000 the pages are shuffled to them
    few = again.limit(100_001).count() <= 100_000
    whole = plain.join(F.broadcast(again) if few else again.hint("merge"), "page_id", "left").select("page_id", "url", "payload", "refers_to")
    written = whole.mapInArrow(lambda b: _write(b, folder), "name string, records long, bytes long")
    return staged(written, "archives")


class _Reader:
    """Bytes of consecutive gzip members, with at most a few buffers in memory."""

    def __init__(self, stream: pa.NativeFile):
        self.stream, self.unzip, self.left, self.buffer = stream, zlib.decompressobj(31), b"", bytearray()

    def _more(self) -> bool:
        while True:
            raw = self.left or self.stream.read(READ)
            if not raw:
                return False
            if self.unzip.eof:
                self.unzip = zlib.decompressobj(31)
            out = self.unzip.decompress(raw, READ * 4)
            self.left = self.unzip.unconsumed_tail or self.unzip.unused_data
            if out:
                self.buffer += out
                return True

    def line(self) -> bytes | None:
        while (at := self.buffer.find(b"\r\n")) < 0:
            if not self._more():
                return None
        out = bytes(self.buffer[:at])
        del self.buffer[: at + 2]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        if len(self.buffer) < n:
            raise ValueError("the archive ends inside a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def records(stream: pa.NativeFile) -> Iterator[tuple]:
    """Chunk rows of an archive; a payload that does not have the digest of its header raises."""
    reader = _Reader(stream)
    while (line := reader.line()) is not None:
        if not line:
            continue
        if line != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:40]!r}")
        head: dict[str, str] = {}
        while line := reader.line():
            key, _, value = line.decode().partition(": ")
            head[key] = value
        size = int(head["Content-Length"])
        page_id, url = int(head["WARC-Page-ID"]), head.get("WARC-Target-URI")
        if url is not None:
            url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if head["WARC-Type"] == "revisit":
            yield page_id, url, 0, True, digest, int(head["WARC-Payload-Length"]), "revisit", int(head["WARC-Refers-To-Page"]), b""
        else:
            sha, number, at = hashlib.sha1(), 0, 0
            while True:
                part = reader.take(min(CHUNK, size - at))
                sha.update(part)
                at += len(part)
                own = base32(sha.digest())
                if at == size and own != digest:
                    raise ValueError(f"record {page_id}: digest {own}, not {digest}")
                yield page_id, url, number, at == size, own, at, "response", None, part
                number += 1
                if at == size:
                    break
        reader.take(4)


def _read(batches: Iterator[pa.RecordBatch], folder: str, with_data: bool) -> Iterator[pa.RecordBatch]:
    files, root = _files(folder)
    for batch in batches:
        for name in batch.column(0).to_pylist():
            rows, held = [], 0
            with files.open_input_stream(posixpath.join(root, name), compression=None) as stream:
                for row in records(stream):
                    rows.append(row)
                    held += len(row[-1]) if with_data else 0
                    if held >= 4 * CHUNK or len(rows) >= 2000:
                        yield _batch(rows, with_data)
                        rows, held = [], 0
            yield _batch(rows, with_data)


def read_archives(archives: DataFrame, folder: str, with_data: bool = True) -> DataFrame:
    """Chunk rows of the archives named in ``archives``; ``size`` counts payload bytes to the end of the chunk, for a
    revisit those of the payload that it stands for.  Without data the rows are streamed and checked all the same."""
    bounded_batches(archives.sparkSession, rows=256)
    schema = CHUNK_SCHEMA if with_data else CHUNK_SCHEMA.rsplit(",", 1)[0]
    # a task per archive
    names = archives.select("name").repartition(max(1, archives.count()), "name")
    return names.mapInArrow(lambda b: _read(b, folder, with_data), schema)


def pages_from(chunk_rows: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): the last chunk of a record has them all."""
    return chunk_rows.filter("last").select(
        "page_id",
        F.col("size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )


def page_chunks(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload: str = "html", size: int = CHUNK) -> DataFrame:
    """The chunked record table of ``pages`` without a detour over files."""

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        payloads = batch.column(2).cast(pa.binary())
        for k, page_id in enumerate(batch.column(0).to_pylist()):
            data = memoryview(payloads[k].as_buffer() if payloads[k].is_valid else b"")
            for row in chunks(page_id, batch.column(1)[k].as_py(), data, size):
                yield _batch([row])

    bounded_batches(pages.sparkSession, rows=256)
    plain = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), F.col(payload).alias("payload"))
    return by_batch(plain.filter("page_id is not null"), cut, CHUNK_SCHEMA)


def total_bytes(archives: DataFrame) -> int:
    return int(np.sum([r["bytes"] for r in archives.select(F.sum("bytes").alias("bytes")).collect() if r["bytes"]]))
