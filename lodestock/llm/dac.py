"""Operator 1: token ids in directly addressable codes.

A segment file holds the ids of whole documents, in ascending doc_id order. An id is split into chunks,
the lowest first; a chunk level holds the chunks of all ids that reach it, a bitmap tells which of them
go on to the next level, and a rank directory (set bits before each block of 512) makes a position's
place in the next level two look-ups. Any id, or any range of ids, is read without decoding others.

Rows are dealt by range of (doc_id, hash of the text, row number), so neither one doc_id, nor null ones,
nor one row that repeats lands in a single task.

Cases: a null text is empty and yields the end id alone; null doc_ids come first and are kept; rows
that repeat a doc_id are kept, ordered by the hash of their text; an empty table gives no file and no
row; other columns of the input are not read; the string of an added token in a text is that token.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestock.llm.common import gathered, mapped, put_file, saved, scratch, shuffle_parts
from lodestock.llm.tokens import loaded

MAGIC = b"DAC1"
#: Bytes of each chunk level; together they hold any id under 2 ** 32.
WIDTHS = (1, 1, 2)
BLOCK = 512
#: Ids after which a segment ends with the batch of whole documents it is in.
SEGMENT_IDS = 1_000_000
#: Ids of a segment that are read back at a time, about.
READ_IDS = 1 << 18
_HEAD = struct.Struct("<4sHHQQ")


def encode_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """The bytes of one segment: header, document directory, then each level's chunks, bitmap and ranks."""
    present = np.array([d is not None for d in doc_ids], bool)
    out = [
        _HEAD.pack(MAGIC, 1, len(widths), len(doc_ids), len(ids)),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.packbits(present, bitorder="little").tobytes(),
        np.cumsum(lengths, dtype="<u8").tobytes(),
    ]
    rest = np.array(ids, np.uint32)
    for k, width in enumerate(widths):
        bits = 8 * width
        if k + 1 == len(widths) and bits < 32 and len(rest) and int(rest.max()) >> bits:
            raise ValueError(f"an id needs more than {8 * sum(widths)} bits")
        goes_on = rest > np.uint32((1 << bits) - 1)
        bitmap = np.packbits(goes_on, bitorder="little")
        ranks = np.zeros(-(-len(rest) // BLOCK) + 1, "<u4")
        if len(rest):
            np.cumsum(np.add.reduceat(goes_on, np.arange(0, len(rest), BLOCK), dtype=np.uint32), out=ranks[1:])
        chunks = (rest & np.uint32((1 << bits) - 1)).astype(f"<u{width}")
        out += [struct.pack("<HQ", width, len(rest)), chunks.tobytes(), bitmap.tobytes(), ranks.tobytes()]
        rest = rest[goes_on] >> np.uint32(bits) if bits < 32 else rest[:0]
    return b"".join(out)


class Segment:
    """A segment's bytes, addressed in place: seg[i] is an id, seg.ids(i, j) a range, seg.doc(k) a document's."""

    def __init__(self, data: bytes) -> None:
        magic, version, levels, self.n_docs, self.n_ids = _HEAD.unpack_from(data, 0)
        if magic != MAGIC or version != 1:
            raise ValueError("not a segment of directly addressable codes")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, n, at)
            at += got.nbytes
            return got

        raw = take("<i8", self.n_docs)
        known = np.unpackbits(take("u1", -(-self.n_docs // 8)), count=self.n_docs, bitorder="little")
        self.doc_ids = [int(d) if k else None for d, k in zip(raw, known, strict=True)]
        self.ends = take("<u8", self.n_docs).astype(np.int64)
        self.levels = []
        for _ in range(levels):
            width, n = struct.unpack_from("<HQ", data, at)
            at += 10
            self.levels.append((8 * width, take(f"<u{width}", n), take("u1", -(-n // 8)), take("<u4", -(-n // BLOCK) + 1)))
        if at != len(data):
            raise ValueError(f"segment of {len(data)} bytes ends at {at}")

    def _rank(self, level: int, i: int) -> int:
        """Set bits before position i."""
        _, _, bitmap, ranks = self.levels[level]
        block = i // BLOCK
        bits = np.unpackbits(bitmap[block * BLOCK // 8 : -(-i // 8)], bitorder="little")
        return int(ranks[block]) + int(bits[: i - block * BLOCK].sum())

    def __len__(self) -> int:
        return self.n_ids

    def __getitem__(self, i: int) -> int:
        value = shift = 0
        for k, (bits, chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            i, shift = self._rank(k, i), shift + bits
        return value

    def ids(self, i: int, j: int) -> np.ndarray:
        """Ids i to j (exclusive): neighbours stay neighbours on every level, so a range is one slice of each."""
        out = np.zeros(j - i, "<u4")
        where, shift = np.arange(j - i), 0
        for k, (bits, chunks, bitmap, _) in enumerate(self.levels):
            if i >= j:
                break
            out[where] |= chunks[i:j].astype("<u4") << np.uint32(shift)
            on = np.unpackbits(bitmap[i >> 3 : -(-j // 8)], bitorder="little")[i & 7 : (i & 7) + j - i].astype(bool)
            where, shift = where[on], shift + bits
            i = self._rank(k, i)
            j = i + len(where)
        return out

    def doc(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encode every text and write the segments `part-PPPPPP-SSSSSS.dac` under path, ascending in doc_id.

    Returns the manifest: part, segment, n_docs, n_ids. Each task holds one segment's ids at a time.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, segment = loaded(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple[list[int | None], np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            doc_ids = [d for h in held for d in h[0]]
            lengths, ids = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            put_file(f"{path}/part-{part:06d}-{segment:06d}.dac", encode_segment(doc_ids, lengths, ids))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "segment": pa.array([segment], pa.int64()), "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64())})

        for batch in gathered(batches):
            flat, at = ids_of.batch(batch.column(1))
            if end_id is not None:
                flat = np.insert(flat, at[1:], end_id)
            lengths = at[1:] - at[:-1] + (end_id is not None)
            held.append((batch.column(0).to_pylist(), lengths, flat.astype("<u2" if ids_of.small and (end_id or 0) < 1 << 16 else "<u4")))
            if sum(len(h[2]) for h in held) >= segment_ids:
                yield flush()
                held, segment = [], segment + 1
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ("doc_id", "_hash", "_row")
    spread = rows.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()}).repartitionByRange(shuffle_parts(docs.sparkSession), *order)
    return saved(mapped(spread.sortWithinPartitions(*order).select("doc_id", "text"), encode, "part long, segment long, n_docs long, n_ids long"), "dac-manifest")


def read_tokens(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Per document of the segments under path: doc_id, start, n_tokens, ids_crc32.

    A start is the sum of whole parts before (one number a part, summed by the driver), of the part's
    segments before, and of the place in the segment.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part, segment = map(int, name.rpartition("/")[2][5:-4].split("-"))
                seg = Segment(data.as_buffer())
                ends = seg.ends
                first = 0
                while first < seg.n_docs:  # some documents at a time
                    begin = int(ends[first - 1]) if first else 0
                    last = max(first + 1, int(np.searchsorted(ends, begin + READ_IDS, "right")))
                    raw = seg.ids(begin, int(ends[last - 1])).tobytes()
                    starts = np.concatenate([[begin], ends[first : last - 1]])
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array(np.full(last - first, part)), "segment": pa.array(np.full(last - first, segment)),
                        "doc_id": pa.array(seg.doc_ids[first:last], pa.int64()), "inside": pa.array(starts), "n_tokens": pa.array(ends[first:last] - starts),
                        "ids_crc32": pa.array([zlib.crc32(raw[4 * (a - begin) : 4 * (b - begin)]) for a, b in zip(starts.tolist(), ends[first:last].tolist(), strict=True)], pa.int64()),
                    })
                    first = last

    before, total = [], 0
    for r in manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").toLocalIterator():
        before.append((r.part, total))
        total += r.n
    bases = manifest.join(spark.createDataFrame(before, "part long, before long"), "part").select(
        "part", "segment", (F.col("before") + F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("base")
    )
    if not before:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.dac").load(path).select("path", "content")
    rows = mapped(files, decode, "part long, segment long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(bases, ["part", "segment"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "dac")
    manifest = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path, manifest)
