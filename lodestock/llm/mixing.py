"""Operator 3: mixing sources to target weights by a low-discrepancy schedule.

Each source's documents stand in hashed order and are cut into blocks of `block` words. Slots i = 0, 1, ...
of the mix map the golden-ratio points frac(i * phi) through the cumulative shares of the sources; the k-th
slot of a source takes its block k, starting over after the last. The number of a source's points before
slot i is a sum of floors, so every slot knows its rank by itself: no count, window or order of slots
is shared between tasks. A source stops at the words its target allows, its last block being cut
there; the few slots that chance leaves short follow at the end. The mixed table stands in the order of slots.

Rows that agree in doc_id, source and text are counted first and placed as one, so a row that repeats is
gathered nowhere.

Cases: null texts and texts without words have size 0 and take nothing; a null source is a source, the
last; null and repeated doc_ids are kept, a row each; an empty table gives no row; other columns are
carried by `mixed_documents` whatever their names (of rows that agree in doc_id, source and text, those of the
first) and not read by `mix`. The driver holds one row a source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestock.llm.common import free_names, join_skewed, mapped, part_of, read_part, saved, scratch, shuffle_parts, sliced, texts, with_row, write_parts

#: Weights of the sources in order, repeating; the mix's words as a multiple of all; a source's most, as a multiple of its own.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Words of a block, but for a source's last.
BLOCK = 2048
#: Slots made by one row of the schedule's range.
CHUNK = 1 << 14
#: The golden ratio's fraction in 64 bits.
GOLDEN = 0x9E3779B97F4A7C15
#: Documents of one source that one task orders, about.
BUCKET = 2000


def word_counts(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, source, text_hash, size, row (of the column so named, if any): runs of bytes other than space and \\x09-\\x0D, counted over Arrow buffers."""
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=4 << 20):
            data, at = texts(batch)
            word = ~space[data]
            begins = word.copy()
            begins[1:] &= ~word[:-1]
            first = at[:-1][at[:-1] < at[1:]]
            begins[first] = word[first]
            total = np.zeros(len(data) + 1, np.int64)
            np.cumsum(begins, out=total[1:])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "source": batch.column(1), "text_hash": batch.column(3), "size": pa.array(total[at[1:]] - total[at[:-1]]), "row": batch.column(4)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"), F.col(row).alias("row") if row else F.lit(0).cast("long").alias("row"))
    return mapped(rows, count, "doc_id long, source string, text_hash long, size long, row long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words of each source in the mix: by weight, none above `most` times its size, the excess shared out again by weight."""
    out, left, free = [0.0] * len(sizes), share * sum(sizes), list(range(len(sizes)))
    while free:
        unit = left / sum(weights[k % len(weights)] for k in free)
        over = [k for k in free if unit * weights[k % len(weights)] > most * sizes[k]]
        if not over:
            for k in free:
                out[k] = unit * weights[k % len(weights)]
            break
        for k in over:
            out[k] = float(most * sizes[k])
            left -= out[k]
        free = [k for k in free if k not in set(over)]
    return out


def floor_sum(n: int, m: int, a: int, b: int) -> int:
    """Sum of floor((a * i + b) / m) over 0 <= i < n, in O(log m) steps."""
    total = 0
    while n > 0:
        q, a = divmod(a, m)
        total += q * (n * (n - 1) // 2)
        q, b = divmod(b, m)
        total += q * n
        top = a * n + b
        if top < m:
            break
        n, b = divmod(top, m)
        m, a = a, m
    return total


def points_before(n: int, low: int, high: int) -> int:
    """How many of the points i * GOLDEN mod 2 ** 64, i < n, lie in [low, high)."""
    return floor_sum(n, 1 << 64, GOLDEN, -low) - floor_sum(n, 1 << 64, GOLDEN, -high)


def plan(sizes: list[int], goals: list[float], block: int) -> dict:
    """What every slot needs to know of the sources: bounds of their points, blocks, words and slots."""
    words = [min(round(t), MOST * s) for t, s in zip(goals, sizes, strict=True)]
    blocks = [-(-s // block) for s in sizes]
    slots = [(w // s) * n + -(-(w % s) // block) if s else 0 for w, s, n in zip(words, sizes, blocks, strict=True)]
    total, bounds = sum(slots), [0]
    for n in slots:
        bounds.append(bounds[-1] + n)
    bounds = [(b << 64) // max(total, 1) for b in bounds]
    return {"words": words, "blocks": blocks, "slots": slots, "total": total, "bounds": bounds, "sizes": sizes, "block": block}


def schedule(spark: SparkSession, p: dict) -> DataFrame:
    """The mix: slot, source_no, pass, block, words (how many of the block's first words it takes), in the order of slots."""
    sizes, words, blocks, slots = (np.array(p[k], np.int64) for k in ("sizes", "words", "blocks", "slots"))
    bounds, total, block = p["bounds"], p["total"], p["block"]
    made = [points_before(total, a, b) for a, b in zip(bounds, bounds[1:], strict=False)]
    short = [(s, made[s], slots[s].item() - made[s]) for s in range(len(sizes)) if slots[s] > made[s]]
    tops = np.array([min(b, (1 << 64) - 1) for b in bounds[1:-1]], np.uint64)

    def rows(slot: np.ndarray, source: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
        keep = rank < slots[source]
        slot, source, rank = slot[keep], source[keep], rank[keep]
        turn, nth = rank // blocks[source], rank % blocks[source]
        size = np.minimum(block, sizes[source] - nth * block)
        size = np.minimum(size, words[source] - turn * sizes[source] - nth * block)
        return pa.RecordBatch.from_pydict({"slot": pa.array(slot), "source_no": pa.array(source), "pass": pa.array(turn), "block": pa.array(nth), "words": pa.array(size)})

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                begin, end = chunk * CHUNK, min(total, (chunk + 1) * CHUNK)
                if begin < total:
                    slot = np.arange(begin, end)
                    source = np.searchsorted(tops, slot.astype(np.uint64) * np.uint64(GOLDEN), "right")
                    rank = np.empty(len(slot), np.int64)
                    order = np.argsort(source, kind="stable")
                    kinds, first, count = np.unique(source[order], return_index=True, return_counts=True)
                    base = np.array([points_before(begin, bounds[k], bounds[k + 1]) for k in kinds.tolist()], np.int64)
                    rank[order] = np.arange(len(slot)) - np.repeat(first - base, count)
                    yield rows(slot, source, rank)
                else:  # the chunks after the last: what the points left short
                    at = total
                    for s, done, n in short:
                        yield rows(np.arange(at, at + n), np.full(n, s), np.arange(done, done + n))
                        at += n

    chunks = -(-total // CHUNK)
    return mapped(spark.range(0, chunks + 1, 1, max(1, min(chunks + 1, 4096))), make, "slot long, source_no long, pass long, block long, words long")


def placed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, block: int = BLOCK, row: str | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(rows, pieces, slots): where each row of docs stands in its source, what each slot takes of it, and how many slots there are.

    rows: source_no, bucket, nth, copy (these four name a row), doc_id, size, source_size, target, begin, row (of rows that repeat the smallest).
    pieces: the four, begin, size, row, slot, pass, block, words.
    """
    spark = docs.sparkSession
    sizes = saved(word_counts(docs, row), "sizes")
    by = {r.source: (r.size or 0, r.n) for r in sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).toLocalIterator()}
    order = sorted(by, key=lambda s: (s is None, s or ""))
    own = [by[s][0] for s in order]
    goals = targets(own, weights, share)
    n_docs = sum(n for _, n in by.values())
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))
    facts = spark.createDataFrame([("-" if s is None else "+" + s, k, own[k], goals[k], by[s][1]) for k, s in enumerate(order)], "key string, source_no long, source_size long, target double, n long")
    alike = sizes.groupBy("doc_id", "source", "text_hash", "size").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("row"))
    hashed = F.xxhash64("doc_id", "text_hash", "size", F.lit("mix"))
    many = max(1, min(1 << 24, -(-n_docs // BUCKET)))
    there = join_skewed(alike.withColumn("key", key), facts, "key", "n", n_docs).select(
        "doc_id", "text_hash", "size", "copies", "row", "source_no", "source_size", "target", hashed.alias("hash"), F.shiftright(F.shiftrightunsigned(hashed, 40) * F.lit(many), 24).alias("bucket")
    )
    words = F.col("size") * F.col("copies")
    sums = there.groupBy("source_no", "bucket").agg(F.sum(words).alias("n"))
    before = sums.select("source_no", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source_no", "bucket").orderBy("hash", "doc_id", "size", "text_hash")
    rows = there.withColumn("nth", F.row_number().over(inside)).withColumn("upto", F.sum(words).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(before, ["source_no", "bucket"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    rows = rows.withColumn("begin", F.col("before") + F.col("upto") - words + F.col("copy") * F.col("size"))
    rows = saved(rows.select("source_no", "bucket", "nth", "copy", "doc_id", "size", "source_size", "target", "begin", "row"), "mix-rows")
    named = ["source_no", "bucket", "nth", "copy", "begin", "size", "row"]
    cut = rows.filter("size > 0").select(*named, F.explode(F.sequence(F.expr(f"begin div {block}"), F.expr(f"(begin + size - 1) div {block}"))).alias("block"))
    p = plan(own, goals, block)
    low = F.greatest(F.col("begin"), F.col("block") * block)
    high = F.least(F.col("begin") + F.col("size"), F.col("block") * block + F.col("words"))
    # the schedule grows with the words, which Spark cannot tell of a range: a join by a shuffle, never a broadcast
    pieces = cut.join(schedule(spark, p).hint("merge"), ["source_no", "block"]).withColumn("words", high - low).filter("words > 0")
    return rows, pieces.select(*named, "slot", "pass", "block", "words"), p["total"]


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken, first_slot (null if nothing is taken), n_slots (slots that take words of it), slots_digest.

    slots_digest is the exclusive or of XXH64 over (slot, source number, pass, block, words) of what is taken.
    """
    rows, pieces, _ = placed(docs, weights, share, block)
    key = ["source_no", "bucket", "nth", "copy"]
    digest = F.bit_xor(F.xxhash64("slot", "source_no", "pass", "block", "words"))
    taken = pieces.groupBy(*key).agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("n_slots"), digest.alias("slots_digest"))
    none = F.lit(0).cast("long")
    return rows.join(taken, key, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), "first_slot", F.coalesce("n_slots", none).alias("n_slots"), F.coalesce("slots_digest", none).alias("slots_digest"))


def mixed_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of docs as the mix takes them, with their columns, in the order of slots: a row for each time a document is taken, at the slot that takes it first.

    All are whole, except that the last words a source gives may be the first ones of a document; n_chars,
    where there is one, is counted anew there. What is taken of a part of docs lies in a file of the shared
    folder, which the pass over docs reads; so texts are exchanged once, to their slots.
    """
    spark, names = docs.sparkSession, docs.columns
    row, slot, begin = free_names(docs, "row", "slot", "begin")
    table = with_row(docs, "mix-documents", row)
    _, pieces, total = placed(table, block=block, row=row)
    passes = pieces.groupBy("row", "begin", "pass", "size").agg(F.min("slot").alias("slot"), F.sum("words").alias("words"))
    path = scratch(spark, "mix-passes")
    write_parts(passes.select(part_of(F.col("row")).alias("part"), "row", "slot", "begin", "words", "size"), path, ("row", "slot", "begin", "words", "size"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.zeros((5, 0), np.int64)
        for batch in sliced(batches, most=4 << 20):
            parts, rows = (np.asarray(batch.column(batch.num_columns - k)) for k in (1, 2))
            for part in np.unique(parts).tolist():
                if part != now:
                    now, own = part, read_part(path, part, 5)
                here = np.flatnonzero(parts == part)
                a, b = np.searchsorted(own[0], rows[here], "left"), np.searchsorted(own[0], rows[here], "right")
                at = np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange((b - a).sum())
                whole = own[3, at] == own[4, at]
                for some in (whole, ~whole):
                    mine = at[some]
                    out = batch.select(names).take(pa.array(np.repeat(here, b - a)[some]))
                    if not len(mine):
                        continue
                    if some is not whole:
                        out = shortened(out, own[3, mine])
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(own[1, mine]), pa.array(own[2, mine])], schema=pa.schema([*out.schema, pa.field(slot, pa.int64()), pa.field(begin, pa.int64())]))

    schema = StructType([*docs.schema.fields, StructField(slot, LongType()), StructField(begin, LongType())])
    taken = mapped(table.select(*names, row, part_of(F.col(row)).alias(free_names(table, "part")[0])), take, schema)
    many = shuffle_parts(spark)
    placed_at = F.floor(F.col(slot) * many / max(1, total)).cast("int")
    return taken.repartitionById(many, F.least(placed_at, F.lit(many - 1))).sortWithinPartitions(slot, begin).select(names)


def shortened(batch: pa.RecordBatch, words: np.ndarray) -> pa.RecordBatch:
    """Rows with the first so many words of each text, and n_chars (if any) of what is left."""
    at = batch.schema.get_field_index("text")
    found = [first_words(t, int(n)) for t, n in zip(batch.column(at).to_pylist(), words, strict=True)]
    batch = batch.set_column(at, batch.schema.field(at), pa.array(found, batch.schema.field(at).type))
    if "n_chars" in batch.schema.names:
        at = batch.schema.get_field_index("n_chars")
        batch = batch.set_column(at, batch.schema.field(at), pa.array(list(map(len, found)), batch.schema.field(at).type))
    return batch


def first_words(text: str, n: int) -> str:
    """The text up to the end of its n-th word."""
    rest = text.encode().split(None, n)
    return text.encode()[: len(text.encode()) - len(rest[n])].decode().rstrip(" \t\n\r\x0b\x0c") if len(rest) > n else text


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
