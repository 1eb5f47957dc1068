"""Operator 7: Ogg media columns.

A payload is kept as one Ogg physical stream of two logical streams: unsigned 8-bit PCM at 8 kHz, one
byte a sample, and notes that carry the length before padding. The reader verifies every page's
checksum and sequence number, tells the streams apart by serial number, puts packets together from
lacing values (also over pages), and derives each page's time from its granule position, which counts
the samples that end there.

Cases: a null or empty text is one unit of padding; null and repeated doc_ids are kept; an empty table
gives no row; other columns are not read. Equal texts give equal streams: serial numbers come from the
payload. A damaged stream raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestock.llm.common import mapped, saved, sliced, strings

UNIT = 192
RATE = 8000
#: Samples of a packet.
PACKET = 20 * UNIT
#: The page header's layout, and the first packets' identifiers and layout.
PAGE = struct.Struct("<4sBBqIIIB")
PCM_HEAD = struct.Struct(">8sHHIIBBHI")
PCM_ID, NOTE_ID = b"PCM     ", b"NOTES\0\0\0"
CONTINUED, FIRST, LAST = 1, 2, 4

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(data: bytes) -> int:
    """Ogg's CRC-32 (the usual polynomial, most significant bit first, no start or end value), by way of zlib's mirrored one."""
    mirrored = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def _pages(packets: list[tuple[bytes, int]], serial: int, segments: int) -> Iterator[bytes]:
    """The pages of one logical stream: the first packet on a page of its own, then packets laced one after the other.

    packets: bytes, and the granule position at their end.
    """
    number = 0
    for group, first in ((packets[:1], True), (packets[1:], False)):
        lacing, ends, body = bytearray(), [], b"".join(p for p, _ in group)
        for packet, granule in group:
            lacing += b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
            ends.append((len(lacing), granule))
        at, passed = 0, 0
        for begin in range(0, len(lacing), segments):
            part = lacing[begin : begin + segments]
            granule = -1
            while passed < len(ends) and ends[passed][0] <= begin + len(part):
                granule = ends[passed][1]
                passed += 1
            n = sum(part)
            over = not first and begin + len(part) == len(lacing)
            flags = CONTINUED * (begin > 0 and lacing[begin - 1] == 255) | FIRST * first | LAST * over
            head = PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(part)) + part + body[at : at + n]
            yield head[:22] + page_crc(head).to_bytes(4, "little") + head[26:]
            at, number = at + n, number + 1


def write_ogg(payload: bytes, n_bytes: int, segments: int = 255, packet: int = PACKET) -> bytes:
    """The payload as samples beside the note of its length before padding."""
    serial = zlib.crc32(payload)
    head = PCM_HEAD.pack(PCM_ID, 0, 0, 1, RATE, 8, 1, min(packet, 65535), 0)
    sound = [(head, 0), *((payload[k : k + packet], min(k + packet, len(payload))) for k in range(0, len(payload), packet))]
    note = [(NOTE_ID, 0), (b"n_bytes=%d" % n_bytes, len(payload))]
    a, b = list(_pages(sound, serial, segments)), list(_pages(note, serial ^ 0xFFFFFFFF, segments))
    return b"".join([a[0], b[0], *a[1:2], *b[1:], *a[2:]])


@dataclass
class Logical:
    """One logical stream as read: its packets, and the granule position of each page on which a packet ends."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    partial: bytes | None = None


def read_ogg(data: bytes) -> dict[int, Logical]:
    """The logical streams by serial number, in the order they begin."""
    streams: dict[int, Logical] = {}
    at = 0
    while at < len(data):
        if len(data) - at < PAGE.size:
            raise ValueError(f"page header cut off at {at}")
        magic, version, flags, granule, serial, number, crc, n = PAGE.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page at {at}")
        lacing = data[at + PAGE.size : at + PAGE.size + n]
        body = at + PAGE.size + n
        end = body + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise ValueError(f"page cut off at {at}")
        if page_crc(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            raise ValueError(f"checksum of the page at {at}")
        if bool(flags & FIRST) == (serial in streams):
            raise ValueError(f"stream {serial} does not begin once")
        s = streams.setdefault(serial, Logical())
        if number != s.pages or s.ended or bool(flags & CONTINUED) != (s.partial is not None):
            raise ValueError(f"stream {serial} is broken at page {number}")
        s.pages += 1
        s.ended = bool(flags & LAST)
        held, begin, done = [s.partial or b""], body, False
        open_packet = s.partial is not None
        for v in lacing:
            body += v
            open_packet = True
            if v < 255:
                s.packets.append(b"".join([*held, data[begin:body]]))
                held, begin, open_packet, done = [], body, False, True
        s.partial = b"".join([*held, data[begin:body]]) if open_packet else None
        if done:
            s.granules.append(granule)
        elif granule != -1:
            raise ValueError(f"stream {serial}: a granule position where no packet ends")
        at = end
    if not streams or any(not s.ended or s.partial is not None for s in streams.values()):
        raise ValueError("a stream does not end")
    return streams


@dataclass
class Media:
    payload: bytes
    n_bytes: int
    feature: str


def decode(data: bytes) -> Media:
    """Payload, length before padding and feature of a stream that write_ogg made."""
    streams = read_ogg(data)
    sound = next(s for s in streams.values() if s.packets[0][:8] == PCM_ID)
    note = next(s for s in streams.values() if s.packets[0] == NOTE_ID)
    rate, channels = (PCM_HEAD.unpack(sound.packets[0])[k] for k in (4, 6))
    payload = b"".join(sound.packets[1:])
    if sound.granules[-1] * channels != len(payload):
        raise ValueError("the last granule position is not the number of samples")
    times = [g / rate for g in sound.granules[1:]]
    feature = f"streams={len(streams)};pages={sound.pages + note.pages};packets={len(sound.packets) - 1};seconds={times[-1]:.3f};page_ends={','.join(f'{t:.3f}' for t in times)}"
    return Media(payload, int(note.packets[1].partition(b"=")[2]), feature)


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, media (binary): each text as an Ogg stream, written as a table of the shared folder."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            raw = [t.encode() for t in strings(batch)]
            media = [write_ogg(t.ljust(max(UNIT, -(-len(t) // UNIT) * UNIT)), len(t)) for t in raw]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "media": pa.array(media, pa.binary())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return saved(mapped(rows, encode, "doc_id long, media binary"), "media", "zstd")


def media_features(media: DataFrame) -> DataFrame:
    """What the streams hold, per row of store_media."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "media"):
            raw = batch.column(1).to_pylist()
            got = [decode(x) for x in raw]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_bytes": pa.array([m.n_bytes for m in got], pa.int64()), "payload_bytes": pa.array([len(m.payload) for m in got], pa.int64()),
                "payload_sha256": pa.array([hashlib.sha256(m.payload).hexdigest() for m in got], pa.string()), "tail_crc32": pa.array([zlib.crc32(m.payload[-16:]) for m in got], pa.int64()),
                "media_bytes": pa.array(list(map(len, raw)), pa.int64()), "media_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()), "feature": pa.array([m.feature for m in got], pa.string()),
            })

    return mapped(media, features, schema)


def op7_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(store_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
