"""WARC archives: writer, and sequential reader.

An archive is a run of gzip members, one for each record, so that any record can be
read from its offset. A table of archives has an archive's bytes in pieces (path, part,
content), so that archives of a gigabyte pass through tasks a piece at a time, and records may
lie across pieces. Without part, a row is a whole archive, as Spark's ``binaryFile`` source has it:
``spark.read.format("binaryFile").load("*.warc.gz")``.

The reader is sequential: it inflates a member in bounded steps, reads the header block,
takes Content-Length bytes, checks the payload's SHA-1 against the digest header, and goes
on at the byte after the member. Without payloads asked for, it holds a piece and a step.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchment.llm.common import BATCH_ROWS, small_batches, stored

#: Bytes after which a new archive begins, those of a piece, and bytes inflated at a time.
ARCHIVE_BYTES, PIECE, STEP = 64 << 20, 1 << 20, 1 << 16
#: Salts over which one payload's records are dealt.
SALTS = 64
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(value: str) -> str:
    """A header value: line breaks and other control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def write_record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One gzip member. A revisit has no payload of its own, but its length and digest."""
    body = payload if kind == "response" else b""
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Target-URI": one_line(url or ""),
        "WARC-Date": "2000-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "X-Payload-Length": str(len(payload)),
    }
    if kind == "revisit":
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    head["Content-Length"] = str(len(body))
    block = VERSION + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([deflate.compress(block), deflate.compress(body), deflate.compress(b"\r\n\r\n"), deflate.flush()])


@dataclass
class Record:
    """Headers by lower-case name; ``verified`` is whether what digests the record states hold
    (True if it states none); ``digest`` is that of the payload read."""

    headers: dict[str, str]
    length: int
    payload: bytes
    verified: bool
    offset: int
    digest: str


#: Bytes of an HTTP header at most.
HTTP_HEADER = 1 << 20


class Feed:
    """The bytes of an archive, piece after piece, with the place of the next one."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.held, self.at = iter(pieces), [], 0

    def more(self) -> bool:
        while not self.held:
            piece = next(self.pieces, None)
            if piece is None:
                return False
            self.held = [memoryview(piece)] if len(piece) else []
        return True

    def take(self, n: int) -> memoryview | bytes:
        """Up to n bytes; none at the end."""
        if not self.more():
            return b""
        out = self.held[-1][:n]
        self.held[-1] = self.held[-1][n:]
        if not len(self.held[-1]):
            self.held.pop()
        self.at += len(out)
        return out

    def back(self, data: bytes) -> None:
        if data:
            self.held.append(memoryview(data))
            self.at -= len(data)


def read_archive(data: bytes | Iterable[bytes], keep_payload: bool = True) -> Iterator[Record]:
    """Records of an archive, whole or in pieces, in order. Raises ValueError on a broken frame;
    a wrong digest is marked.

    The payload of an HTTP message (Content-Type application/http) is what follows its header;
    of any other record it is the whole block."""
    feed = Feed([data] if isinstance(data, bytes) else data)
    while feed.more():
        inflate, begin = zlib.decompressobj(31), feed.at
        held, headers, got, parts, tail, need = b"", None, 0, [], b"", 0
        block, payload, lead = hashlib.sha1(), hashlib.sha1(), None
        while not inflate.eof:
            chunk = inflate.unconsumed_tail
            if not chunk:
                chunk = feed.take(STEP)
            out = inflate.decompress(chunk, STEP)
            if not chunk and not out and not inflate.eof:
                raise ValueError(f"member at {begin} is cut off")
            held += out
            if headers is None and (end := held.find(b"\r\n\r\n")) >= 0:
                lines = held[:end].split(b"\r\n")
                if not lines[0].startswith(b"WARC/1."):
                    raise ValueError(f"no WARC record at {begin}")
                headers = {k.strip().decode().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
                need, held = int(headers["content-length"]), held[end + 4 :]
                lead = b"" if headers.get("content-type", "").startswith("application/http") else None
            if headers is not None:
                take, tail_part = held[: need - got], held[need - got :]
                block.update(take)
                got += len(take)
                if lead is not None:  # the HTTP header isn't over yet
                    lead += take
                    take = b""
                    if (end := lead.find(b"\r\n\r\n")) >= 0 or len(lead) > HTTP_HEADER or got == need:
                        take, lead = lead[end + 4 if end >= 0 else 0 :], None
                payload.update(take)
                if keep_payload:
                    parts.append(take)
                tail += tail_part
                held = b""
        feed.back(inflate.unused_data)
        if headers is None or got != need or tail != b"\r\n\r\n":
            raise ValueError(f"record at {begin} doesn't match its Content-Length")
        own = {k: base64.b32encode(x.digest()).decode() for k, x in (("block", block), ("payload", payload))}
        said = {k: headers.get(f"warc-{k}-digest", "") for k in own}
        if headers.get("warc-type") == "revisit":  # its payload is elsewhere
            said["payload"] = ""
        verified = all(not v.lower().startswith("sha1:") or v[5:].upper() == own[k] for k, v in said.items())
        yield Record(headers, need, b"".join(parts), verified, begin, own["payload"])


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers_to: null for the response of each payload (the smallest
    page_id), which the other records of that payload refer to.

    Records of one payload are dealt over SALTS keys, against the repeated payloads only."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    sha = F.sha1(F.col("html").cast("binary"))
    first = stored(rows.select(sha.alias("sha"), "page_id").groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-repeated")
    salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("sha", sha).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    refers = F.when(F.col("first") != F.col("page_id"), F.col("first"))
    return rows.join(salted, ["sha", "salt"], "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(records: DataFrame) -> DataFrame:
    """path, part, content: archives of about ARCHIVE_BYTES in pieces of about PIECE, written to
    the shared folder. A task holds a piece and a record."""
    small_batches(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, total, part, name = [], 0, 0, 0, None

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([b"".join(held)], pa.binary())], names=["path", "part", "content"])

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                page_id, url, html, refers_to = (x.as_py() for x in row)
                kind = "response" if refers_to is None else "revisit"
                held.append(write_record(kind, page_id, url, html.encode(), refers_to))
                size += len(held[-1])
                name = name or f"pages-{TaskContext.get().partitionId()}-{page_id}.warc.gz"
                if size >= PIECE:
                    yield piece()
                    held, size, total, part = [], 0, total + size, part + 1
                    if total >= ARCHIVE_BYTES:
                        total, part, name = 0, 0, None
        if held:
            yield piece()

    return stored(records.mapInArrow(run, "path string, part int, content binary"), "warc")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """One row for each record of archives (path, content, and part if they are in pieces, which
    are brought together in order); raises on a wrong digest.

    Reads any archive of a gzip member a record: header names of any case, digests that may
    be missing (payload_digest is then computed), ids that aren't of ``write_record`` (page_id
    is then null, record_id has them), records without a target. An empty archive has no rows."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, path string, offset long"
    schema += ", payload binary" if payloads else ""
    names = [x.split()[0] for x in schema.split(", ")]

    def number(urn: str | None) -> int | None:
        digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits.lstrip("-").isdecimal() else None

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * 3, pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((path.as_py(), content.as_py()) for batch in batches for path, content in zip(*batch.columns, strict=True))
        for path, own in groupby(pieces, key=lambda x: x[0]):
            rows, size = [], 0
            for r in read_archive((content for _, content in own), payloads):
                if not r.verified:
                    raise ValueError(f"wrong digest in {path} at {r.offset}")
                h = r.headers
                said = h.get("warc-payload-digest", "").removeprefix("sha1:") or r.digest
                row = (number(h.get("warc-record-id")), int(h.get("x-payload-length", r.length)), said, h.get("warc-type"), number(h.get("warc-refers-to")), h.get("warc-target-uri"), h.get("warc-record-id"), path, r.offset)
                rows.append((*row, r.payload) if payloads else row)
                size += len(r.payload)
                if len(rows) >= BATCH_ROWS or size >= ARCHIVE_BYTES:
                    yield packed(rows)
                    rows, size = [], 0
            if rows:
                yield packed(rows)

    if "part" in archives.columns:
        archives = archives.repartition("path").sortWithinPartitions("path", "part")
    return archives.select("path", "content").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html), read the archives back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id, path, offset.
    A null html is the empty payload, which counts as equal to others; a null url is empty.
    Of rows that repeat a page_id with the payload's smallest page_id, all are responses.
    A null page_id comes back null; it refers to the smallest other page_id if there is one.
    """
    return read_archives(write_archives(mark_revisits(pages)))
