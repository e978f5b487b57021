"""WARC archives in seekable Zstandard bundles (operator 7).

Records are grouped into frames of about frame_bytes, each compressed on its own. A bundle is one file:
the frames, a skippable frame with the record index (record id to frame, offset within it and length),
and the seek table, which is the skippable frame that seekable Zstandard readers look for at the end.
Its last four bytes are the end mark of the text sink that writes the bundles.

Of records with equal payloads of at least min_bytes, that with the smallest id is a response and the
others are revisits, which hold the digest and the response's id but no payload. Smaller ones are all
responses.

Defined results: a null payload counts as empty; rows without id are written under a name made of their task and place,
but none refers to them and they read back without id; rows of one id share its record id, and a lookup gives them all; rows that repeat the smallest id with its payload are all responses;
control characters and blanks in a URL are percent-encoded in the archive, the URL itself stands in the
index; no rows give no bundles.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary_files import read_files, write_blocks
from .common import SMALL_ROWS, cut, fresh_path, small

SKIPPABLE, SEEK_TABLE, END_MARK = 0x184D2A5D, 0x184D2A5E, struct.pack("<I", 0x8F92EAB1)
DATE = "1970-01-01T00:00:00Z"


def with_kind(pages: DataFrame, id: str, url: str, payload: str, min_bytes: int) -> DataFrame:
    """(id, url, payload, digest, size, first): first is the response a record refers to, null in a response."""
    body = F.encode(F.coalesce(F.col(f"`{payload}`"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{url}`").alias("url"), body.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.length("payload").cast("long")})
    # digests alone are grouped: no payload is shuffled for it, and a common page is counted where it stands
    heads = rows.select("id", "digest", "size").filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    heads = small(cut(heads.filter("n > 1").select("digest", "first")))
    if heads.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        joined = rows.join(heads, "digest", "left")
    else:  # payloads are joined by their own ids, not by a digest that many share
        of = cut(rows.select("id", "digest").join(heads, "digest").distinct())
        joined = rows.join(of.select(F.col("id").alias("of"), F.col("digest").alias("same"), "first"), F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same")), "left")
    other = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    # a revisit's payload isn't needed any more
    return joined.select("id", "url", F.when(other.isNull(), F.col("payload")).alias("payload"), "digest", "size", other.alias("first"))


def record(id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, first: int | None, nth: str) -> tuple[str, bytes]:
    """The record's id and its bytes."""
    name = f"urn:page:{id}" if id is not None else f"urn:row:{nth}"
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or name)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if first is None:
        block += payload or b""
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return name, "\r\n".join(head).encode() + block + b"\r\n\r\n"


def bundle(frames: Sequence[tuple[bytes, int]], index: list) -> bytes:
    """A bundle less its end mark. frames: (compressed, raw size)."""
    table = zstandard.ZstdCompressor().compress(json.dumps(index, separators=(",", ":")).encode())
    parts = [f for f, _ in frames] + [struct.pack("<II", SKIPPABLE, len(table)), table]
    entries = b"".join(struct.pack("<II", len(f), n) for f, n in frames) + struct.pack("<II", len(table) + 8, 0)
    return b"".join([*parts, struct.pack("<II", SEEK_TABLE, len(entries) + 9), entries, struct.pack("<IB", len(frames) + 1, 0)])


def write_warc(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 100, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 24) -> None:
    """Writes a record for each row of pages to bundles under path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        frames: list[tuple[bytes, int]] = []
        index: list = []
        raw, size, done, nth = [], 0, 0, 0
        task = TaskContext.get().partitionId()

        def close_frame() -> None:
            nonlocal raw, size, done
            if raw:
                f = packer.compress(b"".join(raw))
                frames.append((f, size))
                done += len(f)
                raw, size = [], 0

        for b in batches:
            for r in range(b.num_rows):
                name, data = record(*[b.column(i)[r].as_py() for i in range(6)], nth=f"{task}-{nth}")
                nth += 1
                index.append((name, len(frames), size, len(data)))
                raw.append(data)
                size += len(data)
                if size >= frame_bytes:
                    close_frame()
                if done >= bundle_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([bundle(frames, index)], pa.binary())], names=["bundle"])
                    frames, index, done = [], [], 0
        close_frame()
        if frames:
            yield pa.RecordBatch.from_arrays([pa.array([bundle(frames, index)], pa.binary())], names=["bundle"])

    write_blocks(with_kind(pages, id, url, payload, min_bytes).mapInArrow(run, "bundle binary"), "bundle", END_MARK, path, 1)


class Bundle:
    """A bundle's seek table and record index; frames are decompressed one at a time."""

    def __init__(self, content) -> None:
        self.view = view = memoryview(content).cast("B")
        count, _, mark = struct.unpack("<IBI", view[-9:])
        entries = view[-9 - 8 * count : -9]
        if struct.pack("<I", mark) != END_MARK or struct.unpack("<II", view[-17 - 8 * count : -9 - 8 * count]) != (SEEK_TABLE, 8 * count + 9):
            raise ValueError("no seek table ends the file")
        self.frames, at = [], 0
        for k in range(count):
            packed, raw = struct.unpack("<II", entries[8 * k : 8 * k + 8])
            self.frames.append((at, packed, raw))
            at += packed
        at, packed, _ = self.frames.pop()
        self.index = json.loads(zstandard.ZstdDecompressor().decompress(bytes(view[at + 8 : at + packed])))

    def frame(self, k: int) -> bytes:
        at, packed, raw = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(bytes(self.view[at : at + packed]), max_output_size=raw)

    def records(self, wanted: frozenset[str] | None = None) -> Iterator[bytes]:
        """All records, or those named; frames without a wanted one aren't decompressed."""
        at, data = -1, b""
        for name, k, offset, size in self.index:
            if wanted is None or name in wanted:
                if k != at:
                    at, data = k, self.frame(k)
                yield data[offset : offset + size]


def parse(data: bytes) -> dict:
    """A record's fields; a response's payload is held against its digest."""
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")

    def page(name: str | None) -> int | None:
        return int(m[1]) if name and (m := re.fullmatch(r"<urn:page:(-?\d+)>", name)) else None

    return {"page_id": page(fields["WARC-Record-ID"]), "target": fields["WARC-Target-URI"], "record_type": kind, "payload_bytes": size, "payload_digest": digest, "refers_to": page(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None}


def read_warc(spark: SparkSession, path: str, ids: Sequence[int] | None = None, payloads: bool = True) -> DataFrame:
    """The records under path, or those of the pages ids, found by the bundles' indexes."""
    wanted = None if ids is None else frozenset(f"urn:page:{i}" for i in ids)
    schema = "page_id long, target string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads
    names = ["page_id", "target", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * payloads
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column(0):
                held, size = [], 0
                for data in Bundle(c.as_buffer()).records(wanted):
                    held.append(parse(data))
                    size += len(data)
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], k) for n, k in zip(names, kinds, strict=True)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return read_files(spark, path).select("content").mapInArrow(run, schema)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """What is read back of pages once they are archived in the shared folder."""
    path = fresh_path(pages.sparkSession, "warc")
    write_warc(pages, path, **options)
    return read_warc(pages.sparkSession, path, payloads=False)
