import hashlib
import zlib

import pytest

from lodestock.llm.ogg import decode, media_features, page_crc, read_ogg, store_media, write_ogg
from lodestock.llm.warc import frames, make_archive, parse, read_warc, record, write_warc
from lodestock.llm.common import scratch


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    return crc


def test_page_checksum():
    for data in (b"", b"OggS", bytes(range(256)) * 3):
        assert page_crc(data) == slow_crc(data)


@pytest.mark.parametrize("segments", [1, 3, 255])
@pytest.mark.parametrize("size", [192, 192 * 20, 192 * 21, 255 * 192, 192 * 4000])
def test_streams_come_back(size, segments):
    payload = bytes(k * 7 % 251 for k in range(size))
    data = write_ogg(payload, size - 5, segments)
    got = decode(data)
    assert got.payload == payload and got.n_bytes == size - 5
    assert len(read_ogg(data)) == 2 and f"seconds={size / 8000:.3f}" in got.feature
    for k in (0, 27, len(data) // 2, len(data) - 1):
        with pytest.raises(ValueError):
            read_ogg(data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :])
    with pytest.raises(ValueError):
        read_ogg(data[:-1])


def test_media_rows(spark):
    rows = [(1, "é" * 100), (2, None), (3, ""), (None, "x" * 192), (1, "é" * 100), (5, "long " * 60_000)]
    docs = spark.createDataFrame([(*r, b"m") for r in rows], "doc_id long, text string, media binary")
    got = media_features(store_media(docs)).collect()
    for (i, text), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r.doc_id, next(t for j, t in rows if j == r.doc_id)))), strict=True):
        raw = (text or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
    assert media_features(store_media(docs.limit(0))).count() == 0


def test_archives_are_validated():
    body = b"<p>" * 50
    digest = hashlib.sha256(body).hexdigest()
    records = [record(k, f"http://x/{k} \r\n", body, digest, None if k == 0 else 0) for k in range(30)]
    data = make_archive(records)
    assert list(frames(data)) == records
    assert parse(records[3]) == {"page_id": 3, "payload_bytes": 150, "payload_digest": digest, "record_type": "revisit", "refers_to": 0}
    for broken in (data[:-3], data[8:], b"", data[:40] + data[60:]):
        with pytest.raises(Exception):
            [parse(x) for x in frames(broken)]
    for old, new in ((b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: 2", b"Content-Length: 3"), (b"<p><p>", b"<p><q>"), (b"WARC-Date", b"WARC-Dote")):
        with pytest.raises(ValueError):
            parse(records[0].replace(old, new))


def test_pages(spark):
    long, other = "<html>" + "a" * 200, "é" * 60
    rows = [(5, "u", long), (3, None, long), (9, "u", long), (4, "u", other), (8, "u", other), (1, "u", "short"), (2, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", long), (3, "u", long), (10, "u", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, digest string")
    path = scratch(spark, "w")
    write_warc(pages, path, archive=1000)
    got = sorted((r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in read_warc(spark, path).collect())
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        first = min((j for j, _, h in rows if j is not None and h == html), default=None) if len(raw) >= 100 else None
        kind = "response" if first is None or first == i else "revisit"
        want.append((i if i is not None else -1, kind, first if kind == "revisit" else None, len(raw), hashlib.sha256(raw).hexdigest()))
    assert got == sorted(want, key=lambda r: (r[0], r[1]))
    assert write_warc(pages.limit(0), scratch(spark, "w")).count() == 0
