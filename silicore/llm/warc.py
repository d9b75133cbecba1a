"""WARC in seekable Zstandard bundles.

Pages become WARC/1.1 records; records are grouped into frames of about
``FRAME`` bytes, each compressed on its own, and frames into bundles. A bundle ends
with the seek table of the public seekable format: a skippable frame that lists the
compressed and plain size of every frame. A record's identifier maps to (bundle,
frame, offset and length within the frame's plain bytes), so a reader fetches the footer,
seeks to one frame and inflates that alone. Any Zstandard decoder reads a bundle
from start to end, since it skips the footer.

``frames`` returns a row a frame and one for each bundle's footer: a bundle's ``data`` in order of
``frame`` are its bytes, and ``save`` writes them as files. Every run has an identifier
that is part of its bundles' names and its records' identifiers, so two runs never give the
same, and a task that runs again gives what it gave before. A bundle begins with a
``warcinfo`` record, which no locator names.

Defined results
  * a null html is an empty block marked ``X-Null-Block``, told apart from an empty html;
  * a null url gives a record of type ``metadata`` without a target; control characters
    and spaces in a url are percent-encoded in the header;
  * a null page_id has no ``X-Page-Id``; repeated rows become records of their own, their
    identifiers being numbered within the bundle;
  * ``WARC-Date`` is that of the run, since the table has none;
  * a record longer than a frame has a frame to itself, whatever its length;
  * an empty table: no frame, no bundle; extra columns are ignored.

There is no shuffle: every task packs the rows of its own split, so the number of
bundles follows the input.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import table

FRAME = 128 << 10
BUNDLE = 64 << 20
LEVEL = 3
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
SCHEMA = "bundle string, frame int, frame_offset bigint, data binary, plain_bytes bigint, records array<struct<page_id: bigint, record_id: string, offset: bigint, length: bigint>>"
_ARROW = pa.schema(
    [
        ("bundle", pa.string()),
        ("frame", pa.int32()),
        ("frame_offset", pa.int64()),
        ("data", pa.binary()),
        ("plain_bytes", pa.int64()),
        ("records", pa.list_(pa.struct([("page_id", pa.int64()), ("record_id", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))),
    ]
)


def _uri(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def info(bundle: str, date: str) -> bytes:
    block = b"software: silicore\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, bundle)}>", f"WARC-Date: {date}", f"WARC-Filename: {bundle}.warc.zst", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, html: str | None, number: int, bundle: str, date: str) -> tuple[str, bytes]:
    block = (html or "").encode("utf-8", "surrogatepass")
    rid = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{bundle}/{number}/{page_id}')}>"
    head = ["WARC/1.1", f"WARC-Type: {'metadata' if url is None else 'resource'}", f"WARC-Record-ID: {rid}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if html is None:
        head.append("X-Null-Block: 1")
    head += ["Content-Type: text/html; charset=utf-8", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", f"Content-Length: {len(block)}", "", ""]
    return rid, "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict[str, object]:
    """Header fields of one record, and its block under ``block`` (None for a null)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    out: dict[str, object] = dict(x.split(": ", 1) for x in lines[1:])
    n = int(str(out["Content-Length"]))
    if lines[0] != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
        raise ValueError("not one whole record")
    return out | {"block": None if "X-Null-Block" in out else rest[:n]}


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", c, d) for c, d in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed, plain) of every frame, from the footer alone."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    at, out = 0, []
    for i in range(n):
        c, d = struct.unpack_from("<II", bundle, len(bundle) - 9 - width * (n - i))
        out.append((at, c, d))
        at += c
    return out


def read_record(bundle: bytes, frame: int, offset: int, length: int) -> dict[str, object]:
    at, c, d = read_seek_table(bundle)[frame]
    plain = zstandard.ZstdDecompressor().decompress(bundle[at : at + c], max_output_size=d)
    return parse(plain[offset : offset + length])


def _pack(batches: Iterator[pa.RecordBatch], frame_bytes: int, bundle_bytes: int, level: int, run: str, date: str) -> Iterator[pa.RecordBatch]:
    part, serial, squeeze = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=level)
    name = f"{run}-{part:06d}-{serial:05d}"
    sizes: list[tuple[int, int]] = []
    buffer, index, plain, total, number = [], [], 0, 0, 0

    def row(data: bytes, size: int, records: list) -> pa.RecordBatch:
        at = sum(c for c, _ in sizes)
        return pa.RecordBatch.from_pylist([{"bundle": name, "frame": len(sizes), "frame_offset": at, "data": data, "plain_bytes": size, "records": records}], schema=_ARROW)

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal buffer, index, plain
        if buffer:
            data = squeeze.compress(b"".join(buffer))
            yield row(data, plain, index)
            sizes.append((len(data), plain))
            buffer, index, plain = [], [], 0

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal name, serial, total, number
        yield from flush()
        if sizes:
            yield row(seek_table(sizes), 0, [])
            serial += 1
            name, total, number = f"{run}-{part:06d}-{serial:05d}", 0, 0
            sizes.clear()

    for batch in batches:
        for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
            rid, raw = record(page_id, url, html, number, name, date)
            if buffer and plain + len(raw) > frame_bytes:
                yield from flush()
            if (buffer or sizes) and total + len(raw) > bundle_bytes:
                yield from close()
                rid, raw = record(page_id, url, html, number, name, date)
            if not buffer and not sizes:
                buffer.append(info(name, date))
                plain, total = len(buffer[0]), total + len(buffer[0])
            index.append({"page_id": page_id, "record_id": rid, "offset": plain, "length": len(raw)})
            buffer.append(raw)
            plain, total, number = plain + len(raw), total + len(raw), number + 1
    yield from close()


def frames(pages: DataFrame, frame_bytes: int = FRAME, bundle_bytes: int = BUNDLE, level: int = LEVEL, run: str | None = None) -> DataFrame:
    """(bundle, frame, frame_offset, data, plain_bytes, records); ``run``: the run's identifier."""
    run, date = run or uuid.uuid4().hex[:12], datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    src = pages.selectExpr("CAST(page_id AS BIGINT) AS page_id", "url", "html")
    return src.mapInArrow(lambda it: _pack(it, frame_bytes, bundle_bytes, level, run, date), SCHEMA)


def locators(framed: DataFrame) -> DataFrame:
    """(page_id, record_id, bundle, frame, frame_offset, frame_bytes, offset, length), a row a record."""
    return framed.selectExpr("bundle", "frame", "frame_offset", "octet_length(data) AS frame_bytes", "inline(records)").select("page_id", "record_id", "bundle", "frame", "frame_offset", "frame_bytes", "offset", "length")


def save(framed: DataFrame, folder: str) -> None:
    """Write every bundle to ``folder``/<bundle>.warc.zst. ``folder`` must be a mounted path
    that all executors share; a file appears whole or not at all, so retries are safe."""
    folder = folder.removeprefix("file://")

    def write(rows: Iterator) -> None:
        os.makedirs(folder, exist_ok=True)
        out, name, tmp = None, None, None

        def done() -> None:
            if out:
                out.close()
                os.replace(tmp, f"{folder}/{name}.warc.zst")

        for r in rows:
            if r["bundle"] != name:
                done()
                name = r["bundle"]
                tmp = f"{folder}/.{name}.{uuid.uuid4().hex}"
                out = open(tmp, "wb")  # noqa: SIM115
            out.write(r["data"])
        done()

    framed.select("bundle", "frame", "data").repartition("bundle").sortWithinPartitions("bundle", "frame").foreachPartition(write)


def records(framed: DataFrame) -> DataFrame:
    """(page_id, url, html): every record, cut out of its frame by its locator alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for data, size, found in zip(*(c.to_pylist() for c in batch.columns)):
                plain = squeeze.decompress(data, max_output_size=size) if found else b""
                for r in found:
                    x = parse(plain[r["offset"] : r["offset"] + r["length"]])
                    rows.append({"page_id": r["page_id"], "url": x.get("WARC-Target-URI"), "html": None if x["block"] is None else x["block"].decode("utf-8", "surrogatepass")})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]))

    return framed.select("data", "plain_bytes", "records").mapInArrow(read, "page_id bigint, url string, html string")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(table(spark, sf_dir, "pages"))


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(op3_warc(spark, sf_dir))


ROUND_TRIP_ORACLE = "SELECT page_id, url, html FROM pages"
