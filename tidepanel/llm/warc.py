"""WARC archives: written by tasks in parallel, read back record by record.

Every record is one gzip member, so an archive can be read from any record on. The reader goes through an archive in
fixed-size pieces: it inflates incrementally, frames records by their content length, and hashes payloads as they
pass, so its memory doesn't grow with archives or payloads.

Tasks write whole archives into a folder that all executors share, under names that no other attempt of a task uses,
and return a list of what they wrote. Only archives on the lists of successful attempts are read, so a lost executor
leaves nothing but a file that nobody refers to.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import Batches, staged
from tidepanel.session import scratch_path

PIECE = 1 << 20
ARCHIVE_BYTES = 256 << 20
"""Compressed size from which a task begins another archive."""
LEAST_REVISIT = 0
"""Payloads of fewer bytes are always stored."""
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
DATE = "2024-01-01T00:00:00Z"


def digest_text(raw: bytes) -> str:
    """Base32 of a SHA-1, in upper case and without padding: 160 bits need none."""
    return base64.b32encode(raw).decode("ascii")


def one_line(value: str) -> str:
    """A header value: line ends and other control characters become spaces."""
    return "".join(" " if ord(c) < 32 or ord(c) == 127 else c for c in value).strip()


def record_name(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, compressed as one gzip member. A revisit has the payload's digest and length, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_name(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {one_line(url or '')}", f"WARC-Payload-Digest: sha1:{digest_text(hashlib.sha1(payload).digest())}",
        f"WARC-Block-Digest: sha1:{digest_text(hashlib.sha1(block).digest())}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}", f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_name(refers_to)}", f"X-Refers-To-Page: {'' if refers_to is None else refers_to}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


@dataclass
class Record:
    """What the reader returns of a record."""

    headers: dict[str, str]
    http: dict[str, str]
    offset: int
    payload_bytes: int
    payload_digest: str
    block_digest: str
    payload: list[bytes] = field(default_factory=list)

    @property
    def verified(self) -> bool:
        """Whether the block, and the payload if the record has it, have the digests and lengths that the headers tell."""
        right = self.headers.get("warc-block-digest") == f"sha1:{self.block_digest}"
        if self.headers.get("warc-type") == "revisit":
            return right
        return right and self.headers.get("warc-payload-digest") == f"sha1:{self.payload_digest}" and self.http.get("content-length") == str(self.payload_bytes)


class Inflater:
    """Bytes of one gzip member after the other from a stream that is read in pieces."""

    def __init__(self, stream: BinaryIO) -> None:
        self.stream, self.left, self.offset = stream, b"", 0

    def members(self) -> Iterator[tuple[int, Iterator[bytes]]]:
        while True:
            if not self.left:
                self.left = self.stream.read(PIECE)
            if not self.left:
                return
            start = self.offset
            member = self.member()
            yield start, member
            for _ in member:  # what a caller left unread
                pass

    def member(self) -> Iterator[bytes]:
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            piece = self.left or self.stream.read(PIECE)
            if not piece:
                raise EOFError("an archive ends inside a record")
            out = inflate.decompress(piece, PIECE)
            self.left = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            self.offset += len(piece) - len(self.left)
            if out:
                yield out


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


class Frame:
    """A member's bytes with the two ways that framing takes them: up to a blank line, and by count."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.held = pieces, b""

    def head(self) -> bytes:
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            piece = next(self.pieces, None)
            if piece is None:
                raise ValueError("a record ends inside its headers")
            self.held += piece
        head, self.held = self.held[:end], self.held[end + 4 :]
        return head

    def take(self, count: int) -> Iterator[bytes]:
        while count:
            if not self.held:
                self.held = next(self.pieces, b"")
                if not self.held:
                    raise ValueError("a record is shorter than its content length")
            part, self.held = self.held[:count], self.held[count:]
            count -= len(part)
            yield part


def read_records(stream: BinaryIO, keep_payload: bool = False) -> Iterator[Record]:
    """The records of an archive in order; payloads are hashed as they pass, and returned only if asked for."""
    for offset, member in Inflater(stream).members():
        frame = Frame(member)
        headers = fields(frame.head())
        length = int(headers["content-length"])
        whole, payload, size, kept = hashlib.sha1(), hashlib.sha1(), 0, []
        held, http = b"", None
        for part in frame.take(length):
            whole.update(part)
            if http is None:
                held += part
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    continue
                http, part = fields(held[:end]), held[end + 4 :]
            payload.update(part)
            size += len(part)
            if keep_payload:
                kept.append(part)
        if b"".join(frame.take(4)) != b"\r\n\r\n":
            raise ValueError("a record goes on beyond its content length")
        yield Record(headers, http or {}, offset, size, digest_text(payload.digest()), digest_text(whole.digest()), kept)


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``records(page_id, url, html, refers_to, revisit)`` below ``folder``; one row ``(path, records)`` per archive."""

    def write(batches: Batches) -> Batches:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task, out, number = TaskContext.get(), None, 0
        written: list[list] = []
        for batch in batches:
            for page_id, url, html, refers_to, revisit in batch[["page_id", "url", "html", "refers_to", "revisit"]].itertuples(index=False):
                if out is None or out.tell() >= archive_bytes:
                    if out is not None:
                        out.close()
                    path = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}-{uuid.uuid4().hex[:8]}.warc.gz"
                    out, number = store.open_output_stream(path, compression=None), number + 1
                    written.append([path, 0])
                own, other = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                out.write(record(own, url, (html or "").encode("utf-8", "replace"), other, bool(revisit)))
                written[-1][1] += 1
        if out is not None:
            out.close()
        yield pd.DataFrame(written, columns=["path", "records"])

    columns = records.select("page_id", "url", "html", "refers_to", "revisit")
    # staged: the archives are written once, and only those of successful attempts are on the list
    return staged(columns.mapInPandas(write, "path string, records bigint"))


READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, verified boolean, archive string, record_offset bigint"


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives listed in ``archives(path)``, each read by one task from start to end."""

    def read(batches: Batches) -> Batches:
        store, _ = fs.FileSystem.from_uri(folder)
        number: Callable[[str | None], int | None] = lambda x: int(x) if x else None
        for batch in batches:
            for path in batch["path"]:
                rows = []
                with store.open_input_stream(path, compression=None) as stream:
                    for r in read_records(stream):
                        revisit = r.headers["warc-type"] == "revisit"
                        size = int(r.http["content-length"]) if revisit else r.payload_bytes
                        digest = r.headers["warc-payload-digest"].removeprefix("sha1:") if revisit else r.payload_digest
                        rows.append((number(r.headers.get("x-page-id")), size, digest, r.headers["warc-type"], number(r.headers.get("x-refers-to-page")), r.verified, path, r.offset))
                frame = pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")])
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    spark = archives.sparkSession
    return archives.select("path").repartition(spark.sparkContext.defaultParallelism * 4, "path").mapInPandas(read, READ)


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id``, ``url``, ``html`` and, for payloads that a smaller page_id has too, ``revisit`` and ``refers_to``.

    Rows that repeat the smallest page_id of their payload are all responses, and so is a row of null page_id if no
    other row of its payload has one. A null html is an empty payload.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("_digest", F.sha1(F.encode("html", "UTF-8")))
    # digests alone are grouped, combined on the map side; texts meet the few repeated ones in a join that can split a hot one
    repeated = rows.where(F.octet_length("html") >= least).groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    repeated = staged(repeated.where((F.col("_n") > 1) & F.col("_first").isNotNull()).drop("_n"))
    both = rows.join(repeated, "_digest", "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return both.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("_first")).alias("refers_to"))


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write a record for every page and read the archives back; see :func:`with_revisits` and :func:`read_archives`."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(with_revisits(pages), folder), folder)
