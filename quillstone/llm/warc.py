"""WARC records in seekable Zstandard bundles.

Each page becomes one WARC ``resource`` record. Consecutive records are grouped into frames of about
``FRAME_BYTES`` that decompress by themselves, frames into bundles, and every bundle ends in a
skippable frame with the seek table of the public seekable format: compressed and decompressed size
of each frame, their number, and the closing magic number. Any Zstandard reader can decompress a
bundle as a whole. The index maps a record's id to its frame and its offset inside that frame, so a
single record is read by decompressing one frame. Nothing is shuffled: a task packs the records that
it reads, holding one bundle at a time.

Defined results
    null html: a record without payload, marked so, that reads back as null; empty html reads back as
    empty. null url: no target header, reads back as null. null page_id: indexed under null.
    repeated page_ids and rows: a record each, with its own record id, all of them in the index. A page longer than a frame
    fills one frame by itself, whole. Empty table: no bundle. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ready

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 18, 1 << 23, 3
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
SCHEMA = "bundle_id string, n_records bigint, n_frames bigint, raw_bytes bigint, payload binary, records array<struct<page_id: bigint, frame: int, start: bigint, length: bigint>>"
_RECORDS = pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))


def record(page_id: int | None, url: str | None, html: str | None, place: str = "") -> bytes:
    """The record's own id comes from its content and its place, so a repeated page has others."""
    body = (html or "").encode("utf-8", "surrogatepass")
    own = hashlib.md5(f"{place} {page_id} {url!r} {html is None} ".encode() + body, usedforsecurity=False).hexdigest()
    head = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{uuid.UUID(own)}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        if url.isprintable() and url == url.strip():
            head.append(f"WARC-Target-URI: {url}")
        else:  # nothing of an odd url may pass for a header
            head.append("X-Target-URI-Base64: " + base64.b64encode(url.encode("utf-8", "surrogatepass")).decode())
    if html is None:
        head.append("X-Payload: none")
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[int | None, str | None, str | None]:
    """(page_id, url, html) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    page = fields.get("X-Page-ID")
    url = fields.get("WARC-Target-URI")
    if (odd := fields.get("X-Target-URI-Base64")) is not None:
        url = base64.b64decode(odd).decode("utf-8", "surrogatepass")
    html = None if "X-Payload" in fields else rest[: int(fields["Content-Length"])].decode("utf-8", "surrogatepass")
    return None if page is None else int(page), url, html


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame for (compressed, decompressed) sizes."""
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, FOOTER)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frame_places(payload: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame, from the seek table alone."""
    count, flags, magic = struct.unpack("<IBI", payload[-9:])
    if magic != FOOTER:
        raise ValueError("the bundle has no seek table")
    width = 12 if flags & 0x80 else 8
    at, out = len(payload) - 9 - count * width, []
    offset = 0
    for k in range(count):
        c, d = struct.unpack_from("<II", payload, at + k * width)
        out.append((offset, c, d))
        offset += c
    return out


def read_frame(payload: bytes, frame: int) -> bytes:
    offset, size, raw = frame_places(payload)[frame]
    return zstandard.ZstdDecompressor().decompress(payload[offset : offset + size], max_output_size=max(raw, 1))


def read_record(payload: bytes, frame: int, start: int, length: int) -> tuple[int | None, str | None, str | None]:
    return parse(read_frame(payload, frame)[start : start + length])


class _Bundle:
    def __init__(self, frame_bytes: int, level: int) -> None:
        self.most, self.pack = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.done: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.index: list[tuple] = []
        self.fill = self.packed = 0

    def add(self, page_id: int | None, data: bytes) -> None:
        if self.fill and self.fill + len(data) > self.most:
            self.close_frame()
        self.index.append((page_id, len(self.done), self.fill, len(data)))
        self.open.append(data)
        self.fill += len(data)

    def close_frame(self) -> None:
        if self.open:
            self.done.append(self.pack.compress(b"".join(self.open)))
            self.sizes.append((len(self.done[-1]), self.fill))
            self.packed += len(self.done[-1])
            self.open, self.fill = [], 0

    def row(self, place: str) -> pa.RecordBatch:
        """Named by its place and its content: the same data packed alike has the same names, other data another."""
        self.close_frame()
        payload = b"".join([*self.done, seek_table(self.sizes)])
        name = f"{place}-{hashlib.sha256(payload).hexdigest()[:16]}"
        keys = ("page_id", "frame", "start", "length")
        cells = [[name], [len(self.index)], [len(self.done)], [sum(d for _, d in self.sizes)]]
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in cells), pa.array([payload], pa.binary()), pa.array([[dict(zip(keys, r, strict=True)) for r in self.index]], _RECORDS)], ["bundle_id", "n_records", "n_frames", "raw_bytes", "payload", "records"])


def _packer(frame_bytes: int, bundle_bytes: int, level: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, bundle = TaskContext.get().partitionId(), 0, _Bundle(frame_bytes, level)
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bundle.add(page_id, record(page_id, url, html, f"{part}-{n}-{len(bundle.index)}"))
                if bundle.packed >= bundle_bytes:
                    yield bundle.row(f"{part:06d}-{n:06d}")
                    n, bundle = n + 1, _Bundle(frame_bytes, level)
        if bundle.index:
            yield bundle.row(f"{part:06d}-{n:06d}")

    return run


def bundles(pages: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL) -> DataFrame:
    """One row for each bundle: its bytes, and where each record lies in them."""
    ready(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_packer(frame_bytes, bundle_bytes, level), SCHEMA)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for payload, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            frames: dict[int, bytes] = {}
            for w in sorted(wanted, key=lambda w: (w["frame"], w["start"])):
                if w["frame"] not in frames:
                    frames = {w["frame"]: read_frame(payload, w["frame"])}
                out.append(parse(frames[w["frame"]][w["start"] : w["start"] + w["length"]]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["page_id", "url", "html"])


def fetch(packed: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(page_id, url, html) of the records with the given ids (all without ids); only their frames are decompressed."""
    ready(packed.sparkSession)
    rows = packed
    if ids is not None:
        hits = packed.select("bundle_id", F.explode("records").alias("r")).join(ids.select(F.col("page_id").cast("bigint").alias("_id")).distinct(), F.col("r.page_id") == F.col("_id"))
        rows = packed.drop("records").join(hits.groupBy("bundle_id").agg(F.collect_list("r").alias("records")), "bundle_id")
    return rows.select("payload", "records").mapInArrow(_fetch, "page_id bigint, url string, html string")


def write_files(packed: DataFrame, folder: str) -> None:
    """Bundles as Parquet rows under the folder, their index beside them by page_id, on storage that all executors share."""
    packed.select("bundle_id", "payload").write.parquet(f"{folder}/bundles")
    rows = packed.select("bundle_id", F.explode("records").alias("r")).select("bundle_id", "r.*")
    rows.repartitionByRange("page_id").sortWithinPartitions("page_id").write.parquet(f"{folder}/index")


def fetch_files(spark: SparkSession, folder: str, ids: DataFrame) -> DataFrame:
    """What ``fetch`` gives, from written files: the index is searched, then only the bundles and frames with a hit are read."""
    hits = spark.read.parquet(f"{folder}/index").join(ids.select(F.col("page_id").cast("bigint").alias("page_id")).distinct(), "page_id")
    wanted = hits.groupBy("bundle_id").agg(F.collect_list(F.struct("page_id", "frame", "start", "length")).alias("records"))
    return fetch(spark.read.parquet(f"{folder}/bundles").join(wanted, "bundle_id"))
