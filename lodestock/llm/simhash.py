"""Operator 10: SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints at `most` or fewer differing bits are linked; the result is the connected components.

The 64 bits are cut into m blocks. Two fingerprints that differ in at most `most` bits agree in at least
m - most blocks, so the index's uppermost nodes are all masked patterns of m - most blocks, and a pair is
found below a pattern it shares. m grows with the number of fingerprints so that a pattern holds a few
hundred. Below a pattern fingerprints are sorted by Gray rank, where neighbours differ little, and eight at
a time share a node: the bits in which all of them agree, less those factored out above. A search adds up
the differences from the top and leaves a whole group once they pass `most`.

First, neighbours in Gray order (of five rotations) are linked and merged. Groups of copies that are near
all of each other become one component by this, and the search need not compare two of a component: a
pattern with many fingerprints is cut into chunks that are searched in pairs, except pairs of chunks of
one component. Emitted links are a spanning forest, not all pairs.

Cases: texts with fewer words than a shingle have the whole sequence as one; null, empty and blank texts
have fingerprint zero and are linked like others; a row with a null doc_id stands for no other row: it
has the component of its fingerprint if another row has that, else null; rows that repeat are kept;
an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestock.llm.common import join_skewed, mapped, saved, shuffle_parts, sliced, strings
from lodestock.llm.components import components

WORDS, MOST, SEED = 4, 4, 42
#: Fingerprints below one pattern that are searched together; a pattern with more is cut into chunks of about this many.
CHUNK = 1024
#: Children of a node.
FAN = 8
ROTATIONS = (0, 13, 26, 39, 52)


def shingle_hashes(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """How many shingles each text has, and the hashes of all of them in a row (uint64), repeats included."""
    digest, raw, counts = xxhash.xxh64_digest, [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        found = text.encode().lower().split()
        if len(found) <= words:
            shingles = [b" ".join(found)] if found else []
        else:
            line = b" ".join(found)
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
            begins = [0, *(ends[: len(ends) - words] + 1).tolist()]
            shingles = [line[a:b] for a, b in zip(begins, ends[words - 1 :].tolist(), strict=True)]
        raw.append(b"".join([digest(s, SEED) for s in shingles]))
        counts[k] = len(shingles)
    return counts, np.frombuffer(b"".join(raw), ">u8").astype(np.uint64)


def print_bits(counts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The 64-bit fingerprint (uint64) of each text of shingle_hashes. Bits are counted eight to a word, over runs of 255 hashes at most."""
    out = np.zeros(len(counts), np.uint64)
    own = np.flatnonzero(counts)
    if not len(own):
        return out
    first = np.cumsum(counts[own]) - counts[own]
    runs = -(-counts[own] // 255)
    doc = np.cumsum(runs) - runs
    cuts = np.repeat(first - 255 * doc, runs) + 255 * np.arange(runs.sum())
    for k in range(8):
        eight = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0101010101010101), cuts)
        ones = np.add.reduceat(eight.view(np.uint8).reshape(-1, 8).astype(np.int64), doc, axis=0)
        for byte in range(8):
            bit = (2 * ones[:, byte] > counts[own]).astype(np.uint64)
            out[own] |= bit << np.uint64(8 * byte + k)
    return out


def fingerprints(texts: list[str], words: int = WORDS) -> np.ndarray:
    return print_bits(*shingle_hashes(texts, words))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x if not by else (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def patterns(n: int, most: int = MOST) -> list[int]:
    """The masks of the uppermost nodes for n fingerprints: all choices of m - most of m blocks."""
    m = most + 1
    while m < most + 4 and n >> (64 * (m - most) // m) > CHUNK // 4:
        m += 1
    edges = [64 * k // m for k in range(m + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, m - most)]


class Forest:
    """Union-find over small integers; the root of a set is its smallest member."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


class GrayIndex:
    """The hierarchical index of the fingerprints of many groups at once (group: any sorted-able number of a row).

    Levels run from leaves (FAN neighbours in Gray order) to one root a group; mask and pattern of
    a node hold the bits its members share, less those its parent has.
    """

    def __init__(self, group: np.ndarray, prints: np.ndarray) -> None:
        self.order = np.lexsort((gray_rank(prints), group))
        self.prints, group = prints[self.order], group[self.order]
        starts, all_of, any_of, self.levels = np.arange(len(prints)), self.prints, self.prints, []
        while True:
            begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            sizes = np.diff(np.r_[begin, len(group)])
            nth = np.arange(len(group)) - np.repeat(begin, sizes)
            heads = np.flatnonzero(nth % FAN == 0)
            all_of, any_of = np.bitwise_and.reduceat(all_of, heads), np.bitwise_or.reduceat(any_of, heads)
            self.levels.append({"child": np.r_[heads, len(group)], "mask": ~(all_of ^ any_of), "bits": all_of})
            starts, group = starts[heads], group[heads]
            self.levels[-1]["end"] = np.r_[starts[1:], len(prints)]
            if len(group) == len(begin):
                break
        self.roots = np.repeat(np.arange(len(begin)), np.diff(np.r_[starts, len(prints)]))
        self.levels[-1]["own"] = self.levels[-1]["mask"]
        for low, high in zip(self.levels, self.levels[1:], strict=False):
            low["own"] = low["mask"] & ~np.repeat(high["mask"], np.diff(high["child"]))

    def near(self, rows: np.ndarray, most: int, same: np.ndarray, uniform: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j > i) of positions at `most` bits or fewer, i in rows, that are not of one component yet.

        same: component by position; uniform: by level, the component that all below a node have, or -1.
        """
        q, node = rows, self.roots[rows]
        level = self.levels[-1]
        far = np.bitwise_count((self.prints[q] ^ level["bits"][node]) & level["own"][node]).astype(np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            keep = (far <= most) & (level["end"][node] > q) & (uniform[k][node] != same[q])
            q, node, far = q[keep], node[keep], far[keep]
            n = level["child"][node + 1] - level["child"][node]
            child = np.repeat(level["child"][node] - np.cumsum(n) + n, n) + np.arange(n.sum())
            q, far = np.repeat(q, n), np.repeat(far, n)
            if k:
                below = self.levels[k - 1]
                far = far + np.bitwise_count((self.prints[q] ^ below["bits"][child]) & below["own"][child])
            node = child
        keep = (node > q) & (same[q] != same[node])
        q, node = q[keep], node[keep]
        keep = np.bitwise_count(self.prints[q] ^ self.prints[node]) <= most
        return q[keep], node[keep]

    def uniform(self, same: np.ndarray) -> list[np.ndarray]:
        out, of = [], same
        for level in self.levels:
            heads = level["child"][:-1]
            low, high = np.minimum.reduceat(of, heads), np.maximum.reduceat(of, heads)
            of = np.where(low == high, low, -1)
            out.append(of)
        return out


def forest_links(group: np.ndarray, prints: np.ndarray, component: np.ndarray, most: int = MOST, step: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Links between components that merge all that lie near each other within a group. Searched so many pairs at a time at most."""
    names, local = np.unique(component, return_inverse=True)
    index = GrayIndex(group, prints)
    local, forest, out = local[index.order], Forest(len(names)), []
    sizes = np.bincount(index.roots)[index.roots]
    cost = np.cumsum(sizes)
    at = 0
    while at < len(prints):
        end = max(at + 1, int(np.searchsorted(cost, cost[at] + step)))
        i, j = index.near(np.arange(at, end), most, local, index.uniform(local))
        pairs = np.unique(np.stack([local[i], local[j]], 1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
        new = [(a, b) for a, b in pairs.tolist() if forest.union(a, b)]
        if new:
            out += new
            local = np.array([forest.root(x) for x in range(len(names))])[local]
        at = end
    ends = np.array(out, np.int64).reshape(-1, 2)
    return names[ends[:, 0]], names[ends[:, 1]]


def simhash_components(docs: DataFrame, words: int = WORDS, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=4 << 20):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "print": pa.array(fingerprints(strings(batch), words).view(np.int64))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = saved(mapped(rows, hashed, "doc_id long, print long"), "prints")
    nodes = saved(prints.filter("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")), "nodes")
    total, many = prints.count(), nodes.count()
    found = nodes.select("node", "print").withColumn("component", F.col("node"))
    near = components(neighbour_links(nodes, most))
    found = saved(found.drop("component").join(near, "node", "left").withColumn("component", F.coalesce("component", "node")), "merged")
    far = components(_index_links(found, patterns(many, most), most))
    far = far.select(F.col("node").alias("component"), F.col("component").alias("last"))
    final = nodes.join(found.select("node", "component"), "node").join(far, "component", "left").select("print", "n", F.coalesce("last", "component").alias("component_id"))
    joined = join_skewed(prints, saved(final, "components"), "print", "n", total, how="left")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def neighbour_links(nodes: DataFrame, most: int) -> DataFrame:
    """u, v: neighbours in the Gray order of each rotation that differ in `most` bits or fewer. Each row is linked to the one before it."""

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1)).view(np.uint64)
            for k, by in enumerate(ROTATIONS):
                rank = (gray_rank(rotated(x, by)) ^ np.uint64(1 << 63)).view(np.int64)  # in the order of signed numbers
                yield pa.RecordBatch.from_pydict({"turn": pa.array(np.full(len(x), k)), "rank": pa.array(rank), "node": batch.column(0), "print": batch.column(1)})

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            turn, node, x = (np.asarray(batch.column(k)) for k in (0, 2, 3))
            if last is not None:
                turn, node, x = np.r_[last[0], turn], np.r_[last[1], node], np.r_[last[2], x]
            if len(x) < 2:
                last = (turn, node, x) if len(x) else last
                continue
            close = (turn[1:] == turn[:-1]) & (np.bitwise_count((x[1:] ^ x[:-1]).view(np.uint64)) <= most)
            yield pa.RecordBatch.from_pydict({"u": pa.array(node[:-1][close]), "v": pa.array(node[1:][close])})
            last = (turn[-1:], node[-1:], x[-1:])

    ranked = mapped(nodes.select("node", "print"), ranks, "turn long, rank long, node long, print long")
    return mapped(ranked.repartitionByRange(shuffle_parts(nodes.sparkSession), "turn", "rank").sortWithinPartitions("turn", "rank"), link, "u long, v long")


def dealt(rows: DataFrame, by: list[str], kept: list[str], spread: str, chunk: int | None = None) -> DataFrame:
    """rows (kept and by, component among kept) with the chunks a, b of each pair of chunks (of CHUNK rows, or `chunk`), of those with equal `by`, that are searched together."""
    chunk = chunk or CHUNK
    # keys with many rows: chunks of each component that alone has many, and chunks of the rest
    full = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk).select(*by)
    parts = rows.join(full, by, "left_semi").groupBy(*by, "component").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.withColumn("alone", F.when(F.col("n") > chunk, F.col("component")))
    parts = saved(parts.groupBy(*by, "alone").agg(F.ceil(F.sum("n") / chunk).cast("long").alias("chunks")), "patterns")
    listed = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("alone", "chunks"))).alias("parts"))
    wide = rows.join(listed, by, "left")
    # a row's chunks: from where its part begins, one by hash; it goes to every pair of chunks but those within a component
    place = F.expr("coalesce(array_position(transform(parts, p -> p.alone), component), 0)")
    place = F.when(place > 0, place - 1).otherwise(F.expr("coalesce(array_position(transform(parts, p -> p.alone is null), true), 1) - 1")).cast("int")
    wide = wide.withColumn("place", place).withColumn("first", F.expr("aggregate(slice(parts, 1, place), 0L, (a, p) -> a + p.chunks)"))
    wide = wide.withColumn("own", F.expr(f"first + pmod(xxhash64({spread}), parts[place].chunks)")).withColumn("upto", F.expr("first + parts[place].chunks"))
    wide = wide.withColumn("others", F.expr("""
        case when parts is null then array(0L)
             else filter(sequence(0L, aggregate(parts, 0L, (a, p) -> a + p.chunks) - 1),
                         c -> parts[place].alone is null or c < first or c >= upto) end"""))  # fmt: skip
    paired = wide.select(*kept, *by, F.coalesce("own", F.lit(0)).alias("own"), F.explode("others").alias("other"))
    return paired.select(*kept, *by, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))


def _index_links(found: DataFrame, masks: list[int], most: int) -> DataFrame:
    """u, v: links between components, found below the patterns of the masks."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(k).cast("long").alias("mask"), F.col("print").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for k, m in enumerate(signed)])
    rows = found.select("print", "component", F.explode(keys).alias("key")).select("print", "component", "key.mask", "key.bits")
    paired = dealt(rows, ["mask", "bits"], ["print", "component"], "print")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def links(cols: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            key = np.stack(cols[2:6])
            group = np.cumsum(np.r_[False, (key[:, 1:] != key[:, :-1]).any(0)])
            u, v = forest_links(group, cols[0].view(np.uint64), cols[1], most)
            return pa.RecordBatch.from_pydict({"u": pa.array(u), "v": pa.array(v)})

        for batch in batches:
            held.append(tuple(np.asarray(c) for c in batch.columns))
            if sum(len(h[0]) for h in held) < 1 << 16:
                continue
            cols = tuple(np.concatenate(c) for c in zip(*held, strict=True))
            key = np.stack(cols[2:6])
            ends = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0))
            if len(ends):  # the last group may go on in the next batch
                cut = int(ends[-1]) + 1
                yield links(tuple(c[:cut] for c in cols))
                held = [tuple(c[cut:] for c in cols)]
            else:
                held = [cols]
        if held and sum(len(h[0]) for h in held):
            yield links(tuple(np.concatenate(c) for c in zip(*held, strict=True)))

    key = ["mask", "bits", "a", "b"]
    sent = paired.repartition(shuffle_parts(found.sparkSession), *key).sortWithinPartitions(*key)
    return mapped(sent, search, "u long, v long")


def op10_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
