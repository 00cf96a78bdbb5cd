"""WARC archives in Zstandard: written from pages, and read with every record checked.

An archive starts with a skippable frame that holds its dictionary; then each record
is one frame. The dictionary is trained on the first ``TRAIN_BYTES`` of the archive's own records and may
be stored compressed. Archives are written by tasks through the file system that the
folder's address names, under a name of the attempt, and renamed when whole, so a task that runs again
or twice leaves the same file. A reader holds one record at a time.

A payload that several pages share (of ``REVISIT_BYTES`` or more) is stored once, as a response by the
largest page_id; the others are revisits, which keep its length and digest in their headers.

Rows: a null html is an empty payload; a null page_id is written without an id and refers to the
response like others; rows that repeat the largest id are responses all; an empty
table writes no archive and reads back no rows. A null url becomes ``urn:none``. Other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylake.llm.common import arrow_batches, shared_folder

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20  # of records before compression
TRAIN_BYTES = 1 << 20
DICTIONARY_BYTES = 32 << 10
LEVEL = 3

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
LINE_END = b"\r\n"

DATE = "2024-01-01T00:00:00Z"
PAGE_URN = "urn:x-page:"

RECORDS = (
    "archive string, place long, page_id long, url string, record_type string, payload binary, "
    "payload_bytes long, payload_digest string, refers_to long, problem string"
)
ARCHIVES = "archive string, n_records long, stored_bytes long"


class Malformed(ValueError):
    """A frame or record that breaks the format."""


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit keeps the HTTP header only."""
    digest = _sha1(payload)
    block = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block += b"" if revisit else payload
    name = PAGE_URN + ("none" if page_id is None else str(page_id))
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(url or "urn:none")),
        ("WARC-Payload-Digest", digest),
        ("WARC-Block-Digest", _sha1(block)),
    ]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{PAGE_URN}{refers_to}>")]
    headers += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = VERSION + LINE_END + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    return head + LINE_END + block + LINE_END + LINE_END


def parse(data: bytes) -> dict:
    """Headers, and what the reader returns of a record; raises ``Malformed``."""
    head, found, rest = data.partition(LINE_END + LINE_END)
    lines = head.split(LINE_END)
    if not found or lines[0] not in (VERSION, b"WARC/1.0"):
        raise Malformed("no WARC version line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip() or name != name.strip():
            raise Malformed(f"header line {line[:60]!r}")
        if name.lower().decode() in headers:
            raise Malformed(f"header {name.decode()} twice")
        headers[name.lower().decode()] = value.strip().decode()
    for name in REQUIRED:
        if name not in headers:
            raise Malformed(f"no {name}")
    if not headers["content-length"].isdigit():
        raise Malformed("content-length is no number")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != LINE_END * 2:
        raise Malformed(f"content-length {length}, frame holds {len(rest) - 4}")
    block = rest[:length]
    if headers.get("warc-block-digest", _sha1(block)) != _sha1(block):
        raise Malformed("block digest differs")
    kind = headers["warc-type"]
    if kind not in ("response", "revisit"):
        return {"record_type": kind}
    http, found, payload = block.partition(LINE_END + LINE_END)
    said = re.search(rb"(?im)^content-length: *(\d+)\r?$", http)
    if not found or not said:
        raise Malformed("no HTTP header with a length")
    digest = headers.get("warc-payload-digest", "")
    if not digest.startswith("sha1:"):
        raise Malformed("no SHA-1 payload digest")
    if kind == "response" and (len(payload) != int(said[1]) or _sha1(payload) != digest):
        raise Malformed("payload length or digest differs")
    if kind == "revisit" and (payload or "warc-refers-to" not in headers):
        raise Malformed("revisit with a payload or without what it refers to")
    return {
        "page_id": _page(headers["warc-record-id"]),
        "url": headers.get("warc-target-uri"),
        "record_type": kind,
        "payload": payload if kind == "response" else None,
        "payload_bytes": int(said[1]),
        "payload_digest": base64.b32decode(digest[5:]).hex(),
        "refers_to": _page(headers["warc-refers-to"]) if kind == "revisit" else None,
    }


def _page(urn: str) -> int | None:
    found = re.fullmatch(rf"<{PAGE_URN}(-?\d+|none)>", urn)
    if not found:
        return None
    return None if found[1] == "none" else int(found[1])


def dictionary_frame(dictionary: bytes, compressed: bool = True) -> bytes:
    data = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary) if compressed else dictionary
    return struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data


def _trained(samples: list[bytes]) -> bytes:
    """A dictionary of these records; empty where they are too few or too alike to train one."""
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _file_system(address: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(address)


def _write_archive(folder: str, name: str, records: Iterator[bytes]) -> tuple[str, int, int]:
    fs, base = _file_system(folder)
    fs.create_dir(base, recursive=True)
    attempt = f"{base}/.{name}.{uuid.uuid4().hex}"
    first, taken = [], 0
    for data in records:
        first.append(data)
        taken += len(data)
        if taken >= TRAIN_BYTES:
            break
    dictionary = _trained(first)
    options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **options)
    count = 0
    with fs.open_output_stream(attempt, compression=None) as out:
        if dictionary:
            out.write(dictionary_frame(dictionary))
        for chunk in (first, records):
            for data in chunk:
                out.write(compressor.compress(data))
                count += 1
        size = out.tell()
    fs.move(attempt, f"{base}/{name}")
    return name, count, size


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages`` (page_id, url, html, refers_to, revisit) and returns the list of archives, stored."""
    from pyspark import TaskContext

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            row
            for batch in batches
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "revisit")))
        )
        part, task = 0, TaskContext.get().partitionId()
        ahead = next(rows, None)
        while ahead is not None:

            def some() -> Iterator[bytes]:
                nonlocal ahead
                taken = 0
                while ahead is not None and taken < ARCHIVE_BYTES:
                    page_id, url, html, refers_to, revisit = ahead
                    data = record(page_id, url, (html or "").encode(), refers_to, revisit)
                    taken += len(data)
                    ahead = next(rows, None)
                    yield data

            found = _write_archive(folder, f"pages-{task:06d}-{part:04d}.warc.zst", some())
            part += 1
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("archive", "n_records", "stored_bytes"), found))],
                schema=pa.schema([("archive", pa.string()), ("n_records", pa.int64()), ("stored_bytes", pa.int64())]),
            )

    listed = pages.mapInArrow(archives, ARCHIVES)
    path = f"{folder}-list"
    listed.write.parquet(path)
    return pages.sparkSession.read.schema(ARCHIVES).parquet(path)


def frames(source) -> Iterator[bytes]:
    """Contents of an archive's frames, one at a time, from a file object."""
    head = source.read(8)
    decompressor = zstandard.ZstdDecompressor()
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", head[4:])[0]
        data = source.read(size)
        if len(data) != size:
            raise Malformed("dictionary frame is cut off")
        if data[:4] == ZSTD_MAGIC:
            data = zstandard.ZstdDecompressor().decompress(data, max_output_size=DICTIONARY_BYTES << 8)
        decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
        head = b""
    pending = head
    while True:
        if len(pending) < 4:
            pending += source.read(1 << 18)
        if not pending:
            return
        if pending[:4] != ZSTD_MAGIC:
            raise Malformed(f"no frame starts with {pending[:4].hex()}")
        frame, parts = decompressor.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(pending))
            except zstandard.ZstdError as error:
                raise Malformed(str(error)) from error
            if frame.eof:
                pending = frame.unused_data
                break
            pending = source.read(1 << 18)
            if not pending:
                raise Malformed("last frame is cut off")
        yield b"".join(parts)


def read_archives(archives: DataFrame, folder: str, payloads: bool = True, on_problem: str = "raise") -> DataFrame:
    """Records of the listed archives (column ``archive``); a broken one raises, or with
    ``on_problem="report"`` is a row with its ``problem`` (a broken frame ends its archive)."""
    schema = pa.schema(
        [
            ("archive", pa.string()), ("place", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()),
            ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("problem", pa.string()),
        ]
    )

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _file_system(folder)
        for name in (n for batch in batches for n in batch.column("archive").to_pylist()):
            rows, held = [], 0
            with fs.open_input_stream(f"{base}/{name}", compression=None) as source:
                place, contents = 0, frames(source)
                while True:
                    row = {"archive": name, "place": place}
                    try:
                        data = next(contents, None)
                        if data is None:
                            break
                        row |= parse(data)
                    except Malformed as error:
                        if on_problem == "raise":
                            raise Malformed(f"{name}, record {place}: {error}") from error
                        row["problem"] = str(error)
                    if not payloads:
                        row.pop("payload", None)
                    rows.append(row)
                    held += len(row.get("payload") or b"") + 200
                    place += 1
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return archives.mapInArrow(records, RECORDS)


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` with ``revisit`` and the page_id of the response in ``refers_to``.

    Shared payloads are found by counting digests, map-side first; only the digests
    of payloads that occur twice join the pages again.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    html = F.coalesce("html", F.lit("")).cast("binary")
    digest = F.when(F.length(html) >= least, F.sha1(html))
    shared = (
        pages.select("page_id", digest.alias("_digest"))
        .filter(F.col("_digest").isNotNull())
        .groupBy("_digest")
        .agg(F.max("page_id").alias("_response"), F.count(F.lit(1)).alias("_n"))
        .filter((F.col("_n") > 1) & F.col("_response").isNotNull())
        .drop("_n")
    )
    revisit = F.col("_response").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("_response"), F.lit(False))
    return (
        pages.withColumn("_digest", digest)
        .join(shared, "_digest", "left")
        .select("page_id", "url", "html", F.when(revisit, F.col("_response")).alias("refers_to"), revisit.alias("revisit"))
    )


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archives of all pages written to a folder (a new shared one by default) and read back."""
    spark = pages.sparkSession
    arrow_batches(spark)
    folder = folder or f"{shared_folder(spark)}/warc"
    archives = write_archives(with_revisits(pages), folder)
    tasks = max(1, min(archives.count(), 10_000))
    return read_archives(archives.repartition(tasks), folder, payloads=False)


ORACLE = """
WITH page AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
shared AS (SELECT html, max(page_id) AS response FROM page WHERE n >= 1000 GROUP BY html HAVING count(*) > 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN response IS NOT NULL AND page_id IS DISTINCT FROM response THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN response IS NOT NULL AND page_id IS DISTINCT FROM response THEN response END AS refers_to
FROM page LEFT JOIN shared USING (html)
"""
