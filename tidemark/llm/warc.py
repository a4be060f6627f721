"""WARC archives: one gzip member a record, written and read back by executors.

Of pages with equal payloads of at least ``least`` bytes the one with the smallest page_id is a
response record, the others are revisit records that name it and hold the HTTP header alone. The
reader goes through a file once: it inflates as it reads, ends a record with its gzip member, cuts
header and block by Content-Length, and checks the block's and the payload's digests.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, written
from tidemark.llm.storage import open_in, open_out

LEAST, ARCHIVE_BYTES, READ_BYTES, ROWS = 100, 512 * 1024 * 1024, 1 << 16, 2000
VERSION, DATE = "WARC/1.1", "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_OUTPUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class BrokenRecord(ValueError):
    """A record that is cut off, badly framed, or not what its digests say."""


@dataclass(frozen=True)
class Record:
    version: str
    headers: dict[str, str]
    block: bytes

    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    def http_length(self) -> int:
        """Content-Length of the HTTP header in the block: the full payload's, for revisits too."""
        head = self.block.partition(b"\r\n\r\n")[0]
        found = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", head)
        if not found:
            raise BrokenRecord("no HTTP length")
        return int(found[1])


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _line(value: str) -> str:
    """A header's value: control characters, which would end it, are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def build(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id), "WARC-Date": date,
        "WARC-Target-URI": _line(url) if url else f"urn:page:{page_id}",
        "Content-Type": "application/http;msgtype=response",
        "WARC-Payload-Digest": f"sha256:{digest}", "WARC-Block-Digest": f"sha256:{sha256(block).hexdigest()}",
    }
    if page_id is not None:
        headers["X-Page-ID"] = str(page_id)
    if refers_to is not None:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page-ID": str(refers_to)}
    headers["Content-Length"] = str(len(block))
    head = "".join([VERSION, "\r\n", *[f"{k}: {v}\r\n" for k, v in headers.items()], "\r\n"]).encode()
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(head + block + b"\r\n\r\n") + deflate.flush()


def members(stream, size: int = READ_BYTES) -> Iterator[bytes]:
    """What each gzip member of a stream holds, inflated as the stream is read."""
    rest = b""
    while rest := rest or stream.read(size):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not rest and not (rest := stream.read(size)):
                raise BrokenRecord("the file ends within a record")
            try:
                parts.append(inflate.decompress(rest))
            except zlib.error as e:
                raise BrokenRecord(str(e)) from e
            rest = inflate.unused_data
        yield b"".join(parts)


def parse(raw: bytes) -> Record:
    """The record of one member, framed by its Content-Length, digests checked."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise BrokenRecord("no WARC header")
    headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = headers.get("Content-Length", "")
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BrokenRecord("the block is not as long as its header says")
    record = Record(lines[0], headers, rest[:-4])
    kind, _, digest = headers.get("WARC-Block-Digest", "").partition(":")
    if kind == "sha256" and sha256(record.block).hexdigest() != digest:
        raise BrokenRecord("block digest")
    kind, _, digest = headers.get("WARC-Payload-Digest", "").partition(":")
    if kind == "sha256" and headers.get("WARC-Type") == "response":
        if sha256(record.payload()).hexdigest() != digest or len(record.payload()) != record.http_length():
            raise BrokenRecord("payload digest")
    return record


def read_records(stream, size: int = READ_BYTES) -> Iterator[Record]:
    """The records of a WARC file, one after another."""
    return map(parse, members(stream, size))


def roles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is null for responses."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(payload, 256).alias("digest"))
    size = F.octet_length(F.col("html"))
    shared = own.where(size >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = written(shared.where("n > 1 and first is not null").select("digest", "first"), "shared")
    return own.join(shared, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html); gives (path, records) of each archive.

    A null html is an empty payload, a null url is replaced by a URN. Rows that repeat the smallest
    page_id of a payload are each a response; a page without id never stands for others. Other
    columns are ignored, whatever their names. An empty table writes nothing.
    """
    folder = (folder or scratch(pages.sparkSession, "warc")).rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, size, n, task = None, "", 0, 0, TaskContext.get().partitionId()
        done: list[tuple[str, int]] = []
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None:
                    path, size, n = f"{folder}/{task:06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = open_out(path)
                raw = build(page_id, url, (html or "").encode(), digest, refers_to)
                out.write(raw)
                size, n = size + len(raw), n + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done]), pa.array([k for _, k in done], pa.int64())], names=["path", "records"])

    return written(roles(pages, least).mapInArrow(write, "path string, records long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, from the files."""
    names = [x.split()[0] for x in _OUTPUT.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def rows_of(path: str, records: int) -> Iterator[tuple]:
        n = 0
        with open_in(path) as stream:
            for r in read_records(stream):
                page, first = r.headers.get("X-Page-ID"), r.headers.get("X-Refers-To-Page-ID")
                n += 1
                yield (
                    int(page) if page else None, r.http_length(), r.headers["WARC-Payload-Digest"].removeprefix("sha256:"),
                    r.headers["WARC-Type"], int(first) if first else None,
                )
        if n != records:
            raise BrokenRecord(f"{path} has {n} of {records} records")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held: list[tuple] = []
                for row in rows_of(path, records):
                    held.append(row)
                    if len(held) >= ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)

    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.repartition(tasks).mapInArrow(read, _OUTPUT)
