"""Near-duplicate texts: groups linked at a Jaccard similarity over word shingles, found by SimHash and by prefixes.

Candidates are found by operator 10's method: fingerprints, neighbours in Gray order, and the hierarchical index
below masked patterns, which finds all pairs within the bits that texts of this similarity differ by on average.
Similar texts whose fingerprints lie further apart no index at that radius can find; these are found without
loss by prefixes of shingle sets: with one order of all shingles, rarest first, two sets of n and m shingles
at similarity s share ceil(s * n) or more, so the first n - ceil(s * n) + 1 of either meet.

A text is reduced once to its node: the hash of its set of shingles, which equal sets share. Candidates are
searched in three rounds, and what is similar is merged after each. First, neighbours in Gray order, and for
each shingle that many sets have a star from the set with the fewest rare shingles, which of a group of copies
is the one most like all. Then, of what these have not joined, every pair that the index finds. Last, of what
is not joined yet, every pair whose prefixes meet. So a group of copies is not compared pair by pair. Bounds
that every similar pair keeps thin the pairs where they are found, before they are rows of a table: sizes, the
parities of hashed counts and, where prefixes meet, what can still be shared from there on. All candidates are
then thinned by bucket counts, which drop no similar pair either, and checked on the whole sets.

Cases: texts with fewer words than a shingle have the whole sequence as one; null, empty and blank texts are
one node without shingles; rows with a null doc_id are no one's copy; rows of one doc_id with different texts
are nodes of their own; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestock.llm import simhash
from lodestock.llm.common import free_names, mapped, saved, shuffle_parts, sliced, strings
from lodestock.llm.components import components
from lodestock.llm.simhash import neighbour_links, print_bits, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
#: Buckets of a sketch. One document in COUNTED is asked for shingles that many have, of which COMMON are known at most: they set the order of shingles only.
BUCKETS, COUNTED, COMMON = 512, 24, 300_000
#: Nodes up to which their ids are broadcast (some tens of bytes each); beyond it they are joined by a shuffle.
LISTED = 500_000
#: The columns of parities and of half_parities.
PARITIES = ["parity_a", "parity_b", "half_a", "half_b"]
#: Pairs that a search holds before it hands them on.
HELD = 1 << 19


def radius(similarity: float) -> int:
    """The bits of 64 in which the fingerprints of texts of this Jaccard similarity differ on average: an angle's share of a half turn."""
    return round(64 * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def shingle_sets(texts: list[str], words: int) -> Iterator[np.ndarray]:
    """The distinct hashes of each text's shingles, sorted."""
    counts, hashes = shingle_hashes(texts, words)
    at = 0
    for n in counts.tolist():
        yield np.unique(hashes[at : at + n])
        at += n


def set_key(hashes: np.ndarray) -> int:
    """A signed 64-bit number of a set of shingles."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))


def sketch(hashes: np.ndarray) -> bytes:
    """How many hashes of a set fall in each of BUCKETS, 255 at most. Two sets have at least as many hashes not in common as their sketches differ by in sum."""
    return np.minimum(np.bincount((hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether an odd number of the hashes fall in each of 128 buckets, as two words. Two sets have at least as many hashes not in common as parities that differ."""
    odd = np.bincount(((hashes >> np.uint64(20)) & np.uint64(127)).astype(np.int64), minlength=128) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def half_parities(hashes: np.ndarray) -> np.ndarray:
    """The parities of the hashes with one more bit set, by which each bucket of parities is cut into two."""
    return parities(hashes[(hashes >> np.uint64(40)) & np.uint64(1) == 1])


def uncommon(parity: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many hashes the sets of rows i and j have not in common, at least. parity: the columns of parities, and those of half_parities if there are any."""
    apart = [(p[i] ^ p[j]).view(np.uint64) for p in parity]
    whole, halves = apart[:2], apart[2:]
    rest = [a ^ h for a, h in zip(whole, halves, strict=True)] if halves else whole
    return sum((np.bitwise_count(a).astype(np.int64) for a in [*rest, *halves]), np.zeros(len(i), np.int64))


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a set of which one at least is in the prefix of every set of this Jaccard similarity, rarest first, and how common each is.

    common (sorted) and counts only set the order: any order gives all pairs.
    """
    n = len(hashes)
    had = np.zeros(n, np.int64)
    if n and len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        had = np.where(common[at] == hashes, counts[at], 0)
    first = np.lexsort((hashes, had))[: n - math.ceil(similarity * n - 1e-9) + 1] if n else np.zeros(0, np.int64)
    return hashes[first], had[first]


def common_shingles(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes (sorted) of shingles that two or more of one document in COUNTED have, and how many."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=1 << 20):
            yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(list(shingle_sets(strings(batch), words))).view(np.int64))})

    some = mapped(rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(COUNTED)) == 0), listed, "key long")
    found = some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
    keys, counts = np.asarray(found["key"]).view(np.uint64), np.asarray(found["n"])
    order = np.argsort(keys)
    return keys[order], counts[order]


def described(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """One row a node: node, doc_id (of one text), first (smallest doc_id), n, print, size, sketch, those of PARITIES, keys (its prefix), and how many keys are rare, common (all that are not rare) and hot."""
    common, counts = common_shingles(rows, words)
    hot = simhash.CHUNK

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=1 << 20):
            texts = strings(batch)
            n, hashes = shingle_hashes(texts, words)
            prints = print_bits(n, hashes).view(np.int64)
            at, out, keys = 0, [], []
            for many in n.tolist():
                own = np.unique(hashes[at : at + many])
                at += many
                key, had = prefix(own, common, counts, similarity)
                keys.append(key.view(np.int64))
                out.append((set_key(own), len(own), sketch(own), *parities(own).tolist(), *half_parities(own).tolist(), int((had == 0).sum()), int((had > 0).sum()), int((had * COUNTED * 2 > hot).sum())))
            node, size, sketches, *odd, rare, shared, burning = zip(*out, strict=True)
            ends = np.zeros(len(keys) + 1, np.int32)
            np.cumsum([len(k) for k in keys], out=ends[1:])
            yield pa.RecordBatch.from_pydict({
                "row": batch.column(2), "doc_id": batch.column(0), "node": pa.array(node, pa.int64()), "print": pa.array(prints), "size": pa.array(size, pa.int32()), "sketch": pa.array(sketches, pa.binary()), **{name: pa.array(p, pa.int64()) for name, p in zip(PARITIES, odd, strict=True)},
                "rare": pa.array(rare, pa.int32()), "common": pa.array(shared, pa.int32()), "hot": pa.array(burning, pa.int32()), "keys": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys))),
            })

    schema = f"row long, doc_id long, node long, print long, size int, sketch binary, {', '.join(f'{p} long' for p in PARITIES)}, rare int, common int, hot int, keys array<long>"
    every = saved(mapped(rows.withColumn("row", F.monotonically_increasing_id()), describe, schema), "described", "zstd")
    one = every.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("row").alias("row"), F.count(F.lit(1)).alias("n")).select("row", "first", "n")
    return saved(every.join(one, "row").drop("row"), "nodes", "zstd")


def star_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """u, v: for each key that is common, the node with the fewest rare keys, and every other node that has the key in its prefix.

    Common keys are COMMON at most, and so are the rows that are broadcast.
    """
    shared = F.slice("keys", F.size("keys") - F.col("common") + 1, F.col("common"))
    keyed = nodes.filter("common > 0").select("node", "size", "rare", F.explode(shared).alias("key"))
    centres = keyed.groupBy("key").agg(F.min_by("node", "rare").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "centre")
    pairs = keyed.select("key", "node").join(F.broadcast(centres), "key").filter("node != centre")
    return pairs.select(F.least("node", "centre").alias("u"), F.greatest("node", "centre").alias("v")).distinct()


#: What a row of a search has beside its keys, by prefixes and by the index.
SEARCHED = ["node", "component", "size", "place", *PARITIES]
INDEXED = ["node", "component", "size", "print", "mask", *PARITIES]
#: Nodes up to which the index's patterns grow in number; beyond, what lies below a pattern grows. It is cut into chunks of GROUPED * simhash.CHUNK.
PATTERNED, GROUPED = 1 << 18, 16


def cross_pairs(group: np.ndarray, cols: list[np.ndarray], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of nodes of a group, of different components, that can have the similarity, HELD or so at a time. Groups are runs of rows; cols are those SEARCHED.

    A key stands at a place in the order of either set. Where it is the first that two sets share, they share
    at most what each has from there on; where it is a later one, the pair was found at the first.
    """
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    mixed = np.minimum.reduceat(cols[1], heads) != np.maximum.reduceat(cols[1], heads)
    keep = np.flatnonzero(np.repeat(mixed, np.diff(np.r_[heads, len(group)])))
    order = keep[np.lexsort((cols[2][keep], group[keep]))]
    group = group[order]
    node, component, size, place, *parity = (c[order] for c in cols)
    left = size - place
    end, rows, d = np.searchsorted(group, group, "right"), np.arange(len(group)), 1
    held: list[np.ndarray] = []

    def made() -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate(held, axis=1)
        both = both[:, np.lexsort(both)]
        both = both[:, np.r_[True, (both[:, 1:] != both[:, :-1]).any(0)]]
        held.clear()
        return both[0], both[1]

    while len(rows):
        rows = rows[rows + d < end[rows]]
        rows = rows[size[rows] >= similarity * size[rows + d] - 1e-6]  # sizes ascend: what is too long stays so
        i = rows[component[rows] != component[rows + d]]
        both = size[i] + size[i + d]
        i = i[np.minimum(left[i], left[i + d]) >= similarity / (1 + similarity) * both - 1e-6]
        i = i[uncommon(parity, i, i + d) <= (1 - similarity) / (1 + similarity) * (size[i] + size[i + d]) + 1e-6]
        if len(i):
            held.append(np.stack([np.minimum(node[i], node[i + d]), np.maximum(node[i], node[i + d])]))
        if sum(h.shape[1] for h in held) >= HELD:
            yield made()
        d += 1
    if held:
        yield made()


def near_pairs(group: np.ndarray, cols: list[np.ndarray], masks: np.ndarray, most: int, similarity: float, step: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of nodes of a group, of different components, whose prints differ in `most` bits or fewer and whose sizes and parities allow the similarity; some `step` comparisons at a time.

    cols are those INDEXED (without parities these rule out nothing). A group lies below one mask; a pair is given below the first of the masks under which its prints agree.
    """
    index = simhash.GrayIndex(group, cols[3].view(np.uint64))
    order = np.argsort(masks)
    nth = order[np.searchsorted(masks[order], cols[4].view(np.uint64))][index.order]
    node, component, size = (c[index.order] for c in cols[:3])
    parity = [c[index.order] for c in cols[5:]]
    same = np.unique(component, return_inverse=True)[1]
    uniform, cost, at = index.uniform(same), np.cumsum(np.bincount(index.roots)[index.roots]), 0
    while at < len(node):
        end = max(at + 1, int(np.searchsorted(cost, cost[at] + step)))
        i, j = index.near(np.arange(at, end), most, same, uniform)
        at = end
        differ, keep = index.prints[i] ^ index.prints[j], np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-6
        for k, mask in enumerate(masks):
            keep &= ((differ & mask) != 0) | (nth[i] <= k)
        i, j = i[keep], j[keep]
        keep = uncommon(parity, i, j) <= (1 - similarity) / (1 + similarity) * (size[i] + size[j]) + 1e-6
        if keep.any():
            u, v = node[i[keep]], node[j[keep]]
            yield np.minimum(u, v), np.maximum(u, v)


def _searched(rows: DataFrame, cols: list[str], by: list[str], pairs: Callable[[np.ndarray, list[np.ndarray]], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """u, v: what `pairs` finds in the rows (cols) of each `by`, which stand together. A task holds some hundred thousand rows, or the rows of one `by`."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def links(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            of = np.stack(rows[len(cols) :])
            group = np.cumsum(np.r_[False, (of[:, 1:] != of[:, :-1]).any(0)])
            for u, v in pairs(group, list(rows[: len(cols)])):
                yield pa.RecordBatch.from_pydict({"u": pa.array(u), "v": pa.array(v)})

        for batch in batches:
            held.append(tuple(np.asarray(c) for c in batch.columns))
            if sum(len(h[0]) for h in held) < 1 << 17:
                continue
            rows = tuple(np.concatenate(c) for c in zip(*held, strict=True))
            of = np.stack(rows[len(cols) :])
            ends = np.flatnonzero((of[:, 1:] != of[:, :-1]).any(0))
            cut = int(ends[-1]) + 1 if len(ends) else 0  # the last group may go on in the next batch
            if cut:
                yield from links(tuple(c[:cut] for c in rows))
            held = [tuple(c[cut:] for c in rows)]
        if held and sum(len(h[0]) for h in held):
            yield from links(tuple(np.concatenate(c) for c in zip(*held, strict=True)))

    return mapped(rows.select(*cols, *by), search, "u long, v long")


def index_pairs(nodes: DataFrame, found: DataFrame, similarity: float, most: int) -> DataFrame:
    """u, v: all pairs of nodes of different components (found: node, component) whose prints differ in `most` bits or fewer, but those that cannot have the similarity.

    They are found by operator 10's hierarchical index: below the masked patterns, in Gray order. Near a large group
    of copies many prints are close to all of the group's and few of the texts are similar, so the rows of the search
    carry what rules a pair out: such pairs are never rows of a table.
    """
    masks = simhash.patterns(min(nodes.count(), PATTERNED), most)
    signed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])
    own = saved(nodes.select("node", "size", "print", *PARITIES).join(found, "node"), "indexed", "zstd")
    rows = own.select("node", "component", "size", "print", *PARITIES, F.explode(signed).alias("mask"))
    bits = F.col("print").bitwiseAND(F.col("mask"))
    rows = simhash.dealt(rows.withColumn("bits", bits), ["mask", "bits"], [c for c in INDEXED if c != "mask"], "node", GROUPED * simhash.CHUNK)
    # what follows from other columns is not exchanged
    rows = rows.withColumn("component", F.when(F.col("component") != F.col("node"), F.col("component"))).drop("bits")
    sent = rows.repartition(shuffle_parts(rows.sparkSession), "mask", bits, "a", "b").withColumn("bits", bits).sortWithinPartitions("mask", "bits", "a", "b")
    sent = sent.withColumn("component", F.coalesce("component", "node"))
    return _searched(sent, INDEXED, ["mask", "bits", "a", "b"], lambda group, cols: near_pairs(group, cols, np.array(masks, np.uint64), most, similarity))


def prefix_pairs(nodes: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """u, v: all pairs of nodes of different components (found: node, component) that can have this Jaccard similarity, as their prefixes meet.

    Keys that many sets have, by the count of a sample, are cut into chunks (see simhash.dealt); others are few rows each.
    """
    own = saved(nodes.select("node", "size", *PARITIES, "hot", "keys").join(found, "node"), "prefixes", "zstd")
    cold = F.size("keys") - F.col("hot")
    kept = [c for c in SEARCHED if c != "place"]
    few = own.select(*kept, F.posexplode(F.slice("keys", F.lit(1), cold)).alias("place", "key"))
    many = own.filter("hot > 0").select(*kept, cold.alias("cold"), F.posexplode(F.slice("keys", cold + 1, F.col("hot"))).alias("place", "key"))
    many = simhash.dealt(many.withColumn("place", F.col("place") + F.col("cold")).drop("cold"), ["key"], SEARCHED, "node")
    sent = lambda rows, *by: rows.repartition(shuffle_parts(rows.sparkSession), *by).sortWithinPartitions(*by)
    pairs = lambda group, cols: cross_pairs(group, cols, similarity)
    return _searched(sent(few, "key"), SEARCHED, ["key"], pairs).unionByName(_searched(sent(many, "key", "a", "b"), SEARCHED, ["key", "a", "b"], pairs))


def similar(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (u, v: nodes) whose sets of shingles have this Jaccard similarity or more: what the sketches rule out is dropped, the others are checked on the whole sets."""

    def could(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16) for k in (2, 3))
            apart, sizes = np.abs(x - y).sum(1), np.asarray(batch.column(4)) + np.asarray(batch.column(5))
            yield batch.select(["u", "v"]).filter(pa.array(apart <= (1 - similarity) / (1 + similarity) * sizes + 1e-6, pa.bool_()))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=1 << 20):
            # rows of another text that repeat a doc_id are left out
            had = [(k, s) for k, s in zip(batch.column(0).to_pylist(), shingle_sets(strings(batch), words), strict=True) if set_key(s) == k]
            yield pa.RecordBatch.from_pydict({"node": pa.array([k for k, _ in had], pa.int64()), "had": pa.array([s.tobytes() for _, s in had], pa.binary())})

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(sliced(batches, "had_u", 4 << 20), "had_v", 4 << 20):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                keep.append(both >= similarity * (len(x) // 8 + len(y) // 8 - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    def of(table: DataFrame, name: str, *cols: str) -> DataFrame:
        return table.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in cols])

    pairs = saved(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u != v").distinct(), "pairs")
    rough = pairs.join(of(nodes, "u", "sketch", "size"), "u").join(of(nodes, "v", "sketch", "size"), "v")
    rough = rough.filter(F.least("size_u", "size_v") >= F.greatest("size_u", "size_v") * similarity - 1e-6).select("u", "v", "sketch_u", "sketch_v", "size_u", "size_v")
    pairs = saved(mapped(rough, could, "u long, v long"), "possible")
    wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = saved(wanted.join(nodes.select("node", "doc_id", "n"), "node").select("doc_id", "node", (F.col("n") > 1).alias("again")), "wanted")
    few = wanted.count() <= LISTED
    once, again = (wanted.filter(c).drop("again") for c in ("not again", "again"))
    once, again = (mapped(rows.join(F.broadcast(w) if few else w, "doc_id").select("node", "text"), whole, "node long, had binary") for w in (once, again))
    had = saved(once.unionByName(again.dropDuplicates(["node"])), "sets")
    both = pairs.join(of(had, "u", "had"), "u").join(of(had, "v", "had"), "v").select("u", "v", "had_u", "had_v")
    return saved(mapped(both, check, "u long, v long"), "similar")


def similar_groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """node (of a set of shingles), first (the smallest doc_id that has it), component: groups linked at this Jaccard similarity or more."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    nodes = described(rows, words, similarity)
    near = neighbour_links(nodes, radius(similarity)).unionByName(star_pairs(nodes, similarity))
    links = similar(rows, nodes, near, words, similarity)
    joined = lambda: nodes.select("node").join(components(links), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    links = links.unionByName(similar(rows, nodes, index_pairs(nodes, joined(), similarity, radius(similarity)), words, similarity))
    links = links.unionByName(similar(rows, nodes, prefix_pairs(nodes, joined(), similarity), words, similarity))
    return nodes.select("node", "first").join(joined(), "node")


def one_of_each(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that are the first of their group, with their columns; of rows that repeat a doc_id one.

    Texts without words are one group. Rows with a null doc_id stay.
    """
    first, at = free_names(docs, "first", "nth")
    found = similar_groups(docs, words, similarity).groupBy("component").agg(F.min("first").alias(first)).select(first).distinct()
    rows = docs.join(found, F.col("doc_id").cast("long") == F.col(first))
    nth = F.row_number().over(Window.partitionBy(first).orderBy(first, F.xxhash64("text")))
    return rows.withColumn(at, nth).filter(F.col(at) == 1).select(docs.columns).unionByName(docs.filter("doc_id is null"))
