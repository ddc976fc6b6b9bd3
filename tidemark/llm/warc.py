"""WARC archives: a writer that Spark commits, and a sequential reader (operator 6).

Writing: records are gzip members of their own. Tasks hand chunks of whole members to Spark's text
writer, whose separator is an empty gzip member, so that any file system Spark can write to receives
valid .warc.gz content through Spark's own commit, and a lost executor leaves no half file.

Reading: files come as bounded binary rows; the reader inflates one member at a time in small steps,
frames the block by Content-Length and verifies block and payload digests.

Which of the records with equal payloads is the response is settled before writing: the largest page
id, found by salted aggregation, and joined back on (digest, salt) so that a page that a third of all
rows repeat spreads over tasks. Rows that share that largest id are all responses; a null id is a
response only where no row with that payload has an id. A null html is an empty payload. Very long ones are
written and read whole, in steps. Other columns are not read, whatever their names. An empty table gives no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, new_path

#: A gzip member without content, in Latin-1: between chunks of a file, and at its end.
_EMPTY_MEMBER = bytes([31, 139, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
_SALTS = 64
_STEP = 65_536


class WarcError(ValueError):
    """A record that is not framed or digested as it says."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP head alone."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    name = "" if page_id is None else page_id
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{name}:{url}')}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"X-Page-ID: {name}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def members(data: bytes) -> Iterator[bytes]:
    """What each gzip member holds, inflated step by step; empty members are passed over."""
    at, view = 0, memoryview(data)
    while at < len(data):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            step = view[at : at + _STEP]
            if not step:
                raise WarcError("archive ends inside a member")
            try:
                parts.append(inflate.decompress(step))
            except zlib.error as error:
                raise WarcError(f"member can't be inflated: {error}") from error
            at += len(step) - len(inflate.unused_data)
        if any(parts):
            yield b"".join(parts)


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def read_records(data: bytes) -> Iterator[dict]:
    """The records of one archive in order, each framed by its Content-Length and its digests verified."""
    for member in members(data):
        head, mark, rest = member.partition(b"\r\n\r\n")
        if not mark or not head.startswith(b"WARC/"):
            raise WarcError("no WARC head")
        fields = _fields(head)
        n = int(fields["content-length"])
        block = rest[:n]
        if len(block) < n or rest[n:] != b"\r\n\r\n":
            raise WarcError("block isn't as long as Content-Length says")
        if fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
            raise WarcError("block digest differs")
        http, _, payload = block.partition(b"\r\n\r\n")
        digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
        if kind == "response" and base32_sha1(payload) != digest:
            raise WarcError("payload digest differs")
        length = len(payload) if kind == "response" else int(_fields(http)["content-length"])
        yield {"page_id": fields["x-page-id"], "url": fields["warc-target-uri"], "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": fields.get("x-refers-to-page-id"), "payload": payload if kind == "response" else None}


def with_response(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with refers_to: the response's page_id for revisits, else null."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha1("html"), "salt": F.pmod(F.xxhash64("page_id"), F.lit(_SALTS)).cast("int")})
    salted = rows.filter(F.octet_length("html") >= least_bytes).groupBy("digest", "salt").agg(F.max("page_id").alias("page_id"), F.count("*").alias("n"))
    twice = salted.groupBy("digest").agg(F.max("page_id").alias("response"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts")).filter("n > 1")
    known = twice.select("digest", "response", F.explode("salts").alias("salt"))
    refers = F.when(F.col("response") != F.col("page_id"), F.col("response")).when(F.col("page_id").isNull(), F.col("response"))
    return rows.join(known, ["digest", "salt"], "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, chunk_bytes: int = 1 << 20, chunks_per_file: int = 16) -> None:
    """An archive folder at path; files hold at most chunks_per_file chunks of about chunk_bytes."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in arrow_rows(batches, 200):
            out = []
            for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(record(page, url, html.encode(), refers))
                size += len(held[-1])
                if size >= chunk_bytes:
                    out.append(b"".join(held))
                    held, size = [], 0
            if out:
                yield pa.RecordBatch.from_pydict({"chunk": pa.array(out, pa.binary())})
        if held:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([b"".join(held)], pa.binary())})

    made = with_response(pages, least_bytes).mapInArrow(chunks, "chunk binary").select(F.col("chunk").cast("string").alias("value"))
    made.write.option("lineSep", _EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", chunks_per_file).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives in path; with payloads, the responses' bytes too."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * payloads]
        number = lambda x: int(x) if x else None
        for batch in batches:
            for data in batch.column(0):
                out, size = [], 0
                for r in read_records(data.as_buffer().to_pybytes()):
                    r |= {"page_id": number(r["page_id"]), "refers_to": number(r["refers_to"])}
                    out.append(r)
                    size += r["payload_bytes"] * payloads + 200
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], k) for n, k in zip(names, kinds)], names)
                        out, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], k) for n, k in zip(names, kinds)], names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(rows, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes)
    return read_archives(pages.sparkSession, path)
