"""WARC archives in seekable Zstandard bundles.

Records go in order of arrival into frames of about ``FRAME`` bytes that decompress alone; a skippable frame
at the end of the file holds the seek table (compressed and plain size and checksum of each frame) as the Zstandard
seekable format has it. The index, a table beside the files, maps each record's identifier to its file, frame and
place within the frame, and records are read back by it. Tasks begin a new file at ``BUNDLE`` bytes. Of records whose payloads are equal and have ``LEAST`` bytes or more, the one
with the smallest page_id is a response and the others are revisits without payload that refer to it.

Payloads meet by digest in counts and minima only; the join back is on small rows (id, digest), which AQE splits if
a payload is hot. Pages are then dealt by page_id, so no file depends on how often a payload occurs.

Edge cases: a null html is an empty payload; smaller payloads are all responses; a null page_id is never the smallest and
never revisits; rows that share page_id and payload are all responses if theirs is the smallest; a null url has no target
header, characters that a header can't hold are percent-encoded; a very long payload is a record, and a frame, of its own length; an empty
table gives an empty one; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import place, publish
from .scratch import Scratch
from .textops import slices

LEAST, FRAME, BUNDLE, DATE = 100, 1 << 18, 1 << 26, "1970-01-01T00:00:00Z"
#: Numbers of the Zstandard seekable format.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
_ENTRY, _FOOTER = struct.Struct("<III"), struct.Struct("<IBI")
_INDEX = "record_id string, path string, frame int, frame_start long, frame_bytes long, place long, length long"


def record_id(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(0x21, 0x7F)))))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: <{record_id(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: memoryview, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that begins at ``at``."""
    whole = data.obj if isinstance(data.obj, bytes) else bytes(data)
    end = whole.index(b"\r\n\r\n", at)
    first, *lines = whole[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    head = dict(line.split(": ", 1) for line in lines)
    begin = end + 4
    stop = begin + int(head["Content-Length"])
    if whole[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return head, whole[begin:stop], stop + 4


class Bundle:
    """A file in the making."""

    def __init__(self):
        self.zstd, self.frames, self.table, self.index = zstandard.ZstdCompressor(level=3), [], [], []
        self.held, self.size, self.packed = [], 0, 0

    def add(self, name: str, data: bytes) -> None:
        self.index.append((name, len(self.table), self.size, len(data)))
        self.held.append(data)
        self.size += len(data)
        if self.size >= FRAME:
            self.close_frame()

    def close_frame(self) -> None:
        if self.held:
            plain = b"".join(self.held)
            frame = self.zstd.compress(plain)
            self.frames.append(frame)
            self.table.append((len(frame), len(plain), zlib.crc32(plain)))
            self.packed += len(frame)
            self.held, self.size = [], 0

    def parts(self) -> list[bytes]:
        self.close_frame()
        entries = b"".join(_ENTRY.pack(*x) for x in self.table) + _FOOTER.pack(len(self.table), CHECKSUMS, SEEKABLE)
        return [*self.frames, struct.pack("<II", SKIPPABLE, len(entries)) + entries]


def seek_table(data: memoryview) -> list[tuple[int, int, int, int]]:
    """(start, bytes, plain bytes, checksum) of each frame."""
    n, flags, magic = _FOOTER.unpack(data[-_FOOTER.size :])
    if magic != SEEKABLE or flags != CHECKSUMS:
        raise ValueError("no seek table")
    out, at, start = [], len(data) - _FOOTER.size - n * _ENTRY.size, 0
    for k in range(n):
        size, plain, crc = _ENTRY.unpack_from(data, at + k * _ENTRY.size)
        out.append((start, size, plain, crc))
        start += size
    return out


def frame(data: memoryview, entry: tuple[int, int, int, int]) -> bytes:
    start, size, plain, crc = entry
    out = zstandard.ZstdDecompressor().decompress(data[start : start + size], max_output_size=plain)
    if len(out) != plain or zlib.crc32(out) != crc:
        raise ValueError("a frame's checksum is wrong")
    return out


def records(data: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    for entry in seek_table(data):
        plain, at = memoryview(frame(data, entry)), 0
        while at < len(plain):
            head, block, at = parse(plain, at)
            yield head, block


def fetch(data: memoryview, frame_start: int, frame_bytes: int, at: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry, from the bytes of its file."""
    plain = zstandard.ZstdDecompressor().decompressobj().decompress(data[frame_start : frame_start + frame_bytes])
    return parse(memoryview(plain[at : at + length]))[:2]


def _write(folder: str):
    def published(bundle: Bundle, k: int) -> pa.RecordBatch:
        _, path = place(folder, f"-{k:06d}.warc.zst")
        publish(path, bundle.parts())
        starts = [0]
        for size, _, _ in bundle.table:
            starts.append(starts[-1] + size)
        rows = [(name, path, k, starts[k], bundle.table[k][0], at, n) for name, k, at, n in bundle.index]
        return pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], [x.split()[0] for x in _INDEX.split(", ")]).cast(
            pa.schema([("record_id", pa.string()), ("path", pa.string()), ("frame", pa.int32()), *((c, pa.int64()) for c in ("frame_start", "frame_bytes", "place", "length"))])
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, k = Bundle(), 0
        for batch in batches:
            for part in slices(batch, "payload"):
                for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    bundle.add(record_id(page_id), record(page_id, url, payload, digest, refers_to))
                    if bundle.packed >= BUNDLE:
                        yield published(bundle, k)
                        bundle, k = Bundle(), k + 1
        if bundle.index:
            yield published(bundle, k)

    return run


def _number(uri: str | None) -> int | None:
    digits = (uri or "").strip("<>").rpartition(":")[2]
    return int(digits) if digits else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the index, best in the order of files and frames -> what their records say; a frame is read once in a row."""
    held, plain, source, system = None, b"", None, None
    for batch in batches:
        rows = []
        for path, start, size, at, length in zip(*(batch.column(c).to_pylist() for c in ("path", "frame_start", "frame_bytes", "place", "length")), strict=True):
            if held != (path, start):
                if held is None or held[0] != path:
                    if source is not None:
                        source.close()
                    system, name = fs.FileSystem.from_uri(path)
                    source = system.open_input_file(name)
                source.seek(start)
                plain = zstandard.ZstdDecompressor().decompressobj().decompress(source.read(size))
                held = path, start
            head, block, end = parse(memoryview(plain[at : at + length]))
            http, _, payload = block.partition(b"\r\n\r\n")
            digest, kind = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"]
            size_of = int(http.rpartition(b"Content-Length: ")[2])
            if end != length or kind == "response" and (len(payload) != size_of or hashlib.sha256(payload).hexdigest() != digest):
                raise ValueError(f"{head['WARC-Record-ID']} isn't what was written")
            rows.append((_number(head["WARC-Record-ID"]), size_of, digest, kind, _number(head.get("WARC-Refers-To"))))
        if rows:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)]
            yield pa.record_batch(columns, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    if source is not None:
        source.close()


def archive(pages: DataFrame, folder: str, tables: Scratch) -> DataFrame:
    """Writes ``pages(page_id, url, html)`` into ``folder``; returns the index."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    digests = tables.store(pages.select("page_id", "digest", F.length("payload").alias("n")).where(f"n >= {LEAST}"), "digests")
    firsts = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n_equal")).where("n_equal > 1")
    firsts = tables.store(firsts.select("digest", "refers_to"), "firsts")
    revisits = tables.store(digests.join(firsts, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct(), "revisits")
    tables.drop("digests", "firsts")
    found = pages.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")
    return tables.store(found.mapInArrow(_write(folder), _INDEX), "index")


def read(index: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the records of the index, read frame by frame from the archives."""
    ordered = index.select("path", "frame_start", "frame_bytes", "place", "length").repartitionByRange("path", "frame_start")
    ordered = ordered.sortWithinPartitions("path", "frame_start", "place")
    return ordered.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def round_trip(pages: DataFrame) -> DataFrame:
    tables = Scratch(pages.sparkSession, "warc")
    return read(archive(pages, tables.path("archive"), tables))


OP8_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM m
"""
