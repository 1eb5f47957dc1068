"""Operator 6: Zstandard WARC archives.

An archive is a skippable frame that holds a dictionary, then one frame per record. The reader loads
the dictionary from the leading frame, decodes frame after frame, and validates each record: version
line, mandatory headers, block length and end, block and payload digests.

Of pages with equal payloads of at least 100 bytes, the one with the smallest page_id is written as a
response and the others as revisits of it, which carry the payload's length and digest but not the payload.

Cases: null html is an empty payload; a null page_id is never the one that others revisit, unless all are
null - then all are responses; rows that repeat the smallest page_id with the same payload are responses
all; a null url is written as an urn; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestock.llm.common import join_skewed, mapped, put_file, saved, scratch, sliced, strings

#: Payloads under this length are always responses.
LEAST = 100
#: Payload bytes after which an archive ends.
ARCHIVE = 16 << 20
#: The dictionary's size, and how much of an archive it is trained on: a bounded sample that only the compression ratio depends on.
DICTIONARY, SAMPLES, SAMPLE = 16 << 10, 64, 8 << 10
#: Fixed values of the formats.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type")
DATE = "2024-01-01T00:00:00Z"


def _record_id(page_id: int | None, digest: str) -> str:
    h = hashlib.sha256(f"{page_id}:{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, a revisit if refers_to is given."""
    uri = "".join(c for c in url or "" if c > " ") or f"urn:page:{page_id}"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [("WARC-Type", "response"), ("WARC-Profile", None), ("WARC-Refers-To", None), ("X-Refers-To-Page", None)]
    if refers_to is None:
        block += payload
    else:
        head = [("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    head += [
        ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("X-Page", None if page_id is None else str(page_id)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None) + "\r\n").encode() + block + b"\r\n\r\n"


def make_archive(records: list[bytes]) -> bytes:
    """Skippable frame with the dictionary (trained on these records, or where they are too few their own heads), then a frame per record."""
    step = max(1, len(records) // SAMPLES)
    samples = [r[:SAMPLE] for r in records[::step]]
    try:
        trained = zstandard.train_dictionary(DICTIONARY, samples, k=256, d=8)
        raw = trained.as_bytes()
    except zstandard.ZstdError:
        raw = b"".join(r[:512] for r in records[:8])
    packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True, write_content_size=True)
    return struct.pack("<II", SKIPPABLE, len(raw)) + raw + b"".join(map(packer.compress, records))


def frames(data: bytes) -> Iterator[bytes]:
    """The content of each frame after the leading one. Frames are fed in slices, so an archive is not copied anew for each."""
    if len(data) < 8:
        raise ValueError("no leading frame")
    magic, n = struct.unpack_from("<II", data)
    if magic != SKIPPABLE or 8 + n > len(data):
        raise ValueError("the archive does not begin with its dictionary")
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n]))
    view, at = memoryview(data), 8 + n
    while at < len(data):
        one, parts = unpacker.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("the last frame is cut off")
            piece = view[at : at + 4096]
            parts.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of a record that is as it should be."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0] != "WARC/1.1":
        raise ValueError("no WARC/1.1 record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(": ")
        if not colon or name in fields:
            raise ValueError(f"header line {line!r}")
        fields[name] = value
    if missing := [m for m in MANDATORY if m not in fields]:
        raise ValueError(f"record without {missing}")
    n = int(fields["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes; Content-Length says {n}")
    block, kind, digest = rest[:n], fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha256:"):
        raise ValueError("block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload digest or length")
    if kind == "revisit" and (payload or fields.get("WARC-Profile") != PROFILE):
        raise ValueError("revisit with a payload or of another profile")
    if kind not in ("response", "revisit"):
        raise ValueError(f"record type {kind}")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("X-Page"), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page")}


def write_warc(pages: DataFrame, path: str, archive: int = ARCHIVE) -> DataFrame:
    """Write archives `warc-PPPPPP-SSSSSS.warc.zst` under path; returns how many records each has.

    The only shuffle of html is the join by digest; pages of a digest that over a thousandth of all
    rows share stay where they are.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("digest", F.sha2("html", 256))
    total = pages.count()
    long_ones = rows.filter(F.octet_length("html") >= LEAST)
    copies = saved(long_ones.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "warc-copies")
    known = join_skewed(rows, copies, "digest", "n", total, how="left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    known = known.select("page_id", "url", "html", "digest", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, held, n = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            put_file(f"{path}/warc-{part:06d}-{nth:06d}.warc.zst", make_archive(held))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "archive": pa.array([nth], pa.int64()), "records": pa.array([len(held)], pa.int64())})

        for batch in sliced(batches, "html", most=archive):
            cols = [batch.column(k).to_pylist() for k in (0, 1, 3, 4)]
            for page_id, url, digest, refers_to, text in zip(*cols, strings(batch, "html"), strict=True):
                payload = text.encode()
                held.append(record(page_id, url, payload, digest, refers_to))
                n += len(held[-1])
                if n >= archive:
                    yield flush()
                    held, n, nth = [], 0, nth + 1
        if held:
            yield flush()

    return saved(mapped(known, write, "part long, archive long, records long"), "warc-manifest")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under path: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                yield pa.RecordBatch.from_pylist([parse(x) for x in frames(data.as_py())], schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content")
    return mapped(files, read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op6_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    if manifest.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_warc(spark, path)
