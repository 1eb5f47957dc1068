"""Operator 8: shortest-pack-first packing over the length histogram.

A document of n tokens is cut into pieces of `size` tokens and one rest. Full pieces are sequences of
their own; the rests are packed by their histogram, which has at most `size` - 1 bins whatever the
corpus: lengths from the longest to the shortest, each into the open patterns with the most room left
(the shortest packs), a pattern's count being split where fewer documents than packs are left. A pattern
owns a run of sequence numbers, so what the packing decided is a short list of (length, first rank,
how many, first sequence, offset) - some thousand rows in all - and a piece finds its place by its rank
among the rests of its length. Ranks come from counts per (part, length), so no task sees all of a length.

Cases: a null text is empty, which is the end id alone; null and repeated doc_ids are kept, each row a
document; an empty table gives no row; other columns of the input are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestock.llm.common import gathered, mapped, saved
from lodestock.llm.tokens import loaded

SIZE = 1024


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Placements (length, first rank, count, first sequence, offset) of the histogram's documents, and the number of sequences.

    Open patterns lie in a heap by room left, the most first. An entry is a run of sequences that hold
    the same lengths. Placing a length makes at most one new run and splits at most one.
    """
    placed, open_runs, made = [], [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if open_runs and -open_runs[0][0] >= length:
                room, first, count = heapq.heappop(open_runs)
                n = min(left, count)
                placed.append((length, rank, n, first, size + room))
                if n < count:
                    heapq.heappush(open_runs, (room, first + n, count - n))
                room += length
            else:
                n, first, room = left, made, length - size
                placed.append((length, rank, n, first, 0))
                made += n
            if room < 0:
                heapq.heappush(open_runs, (room, first, n))
            left, rank = left - n, rank + n
    return placed, made


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = SIZE) -> DataFrame:
    """Every piece: part, doc_id, start, length, ids_crc32, doc_tokens, nth (its place among the part's pieces of that length)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = loaded(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in gathered(batches):
            flat, at = ids_of.batch(batch.column(1))
            doc_ids = batch.column(0).to_pylist()
            cols: list[list] = [[], [], [], [], []]
            tail = np.array([end_id], "<u4")
            for k, doc_id in enumerate(doc_ids):
                ids = np.concatenate([flat[at[k] : at[k + 1]], tail])
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    for c, v in zip(cols, (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)), strict=True):
                        c.append(v)
            lengths = np.array(cols[2], np.int64)
            order = np.argsort(lengths, kind="stable")
            kinds, first, count = np.unique(lengths[order], return_index=True, return_counts=True)
            nth = np.empty(len(lengths), np.int64)
            nth[order] = np.arange(len(lengths)) - np.repeat(first, count) + np.repeat(seen[kinds], count)
            seen[kinds] += count
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
            yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(nth), part))} | {n: pa.array(c, pa.int64()) for n, c in zip(names, cols, strict=True)} | {"nth": pa.array(nth)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(rows, cut, "part long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, nth long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = SIZE) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    cut = saved(pieces(docs, tokenizer, end_id, size), "pieces")
    counts = saved(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    placed, _ = shortest_pack_first(histogram, size)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.select("length", "part", before.alias("before"))
    table: dict[int, tuple[np.ndarray, ...]] = {}
    for length in histogram:
        table[length] = tuple(np.array([p[k] for p in placed if p[0] == length], np.int64) for k in (1, 3, 4))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            lengths, rank = np.asarray(cols["length"]), np.asarray(cols.pop("rank"))
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for length in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == length)
                first, seq, off = table[length]
                at = np.searchsorted(first, rank[own], "right") - 1
                sequence[own], offset[own] = seq[at] + rank[own] - first[at], off[at]
            yield pa.RecordBatch.from_pydict(cols | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    # the ranks grow with the parts: a join by a shuffle of both, never a broadcast
    ranked = cut.join(ranks.hint("merge"), ["length", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("rank"))
    return mapped(ranked, place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long") if histogram else spark.createDataFrame([], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
