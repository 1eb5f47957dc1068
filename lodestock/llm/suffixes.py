"""Operator 4: suffix-array dedup: bytes covered by a string of 200 bytes that also starts elsewhere are removed.

A sparse suffix array answers this without all suffixes. Of the 200-byte windows each belongs to its
anchor, the leftmost place in it where a 64-byte hash is smallest: equal windows have the anchor
at the same distance d from their start, so only suffixes around anchors are compared, and only those whose
64 bytes occur twice at all. An item is an anchor with the range of distances of its windows and the bytes
they cover.

Items are sorted by the bytes that all windows of a range of distances share (the core), then by what
lies to one side of it. Every task sorts its items into a run; runs are front-coded (length of the prefix
shared with the suffix before, and the rest), cut at common splitters and exchanged; a loser tree merges
the runs of a range, carrying each suffix's common prefix with the last output, so that bytes known to agree
are not compared again. The common prefixes with both neighbours then decide: equal suffixes are repeats;
a core that no neighbour shares is none; otherwise the prefix bounds the distances that can still repeat,
and the item goes on to the next round. Rounds look to the right, to the left, to the right, and then halve
the range of distances until nothing is open: eleven rounds at most, most items being settled in two.

Splitters lie between cores. Only within a core so common that it fills ranges of its own are there more;
there each run's part also holds its neighbours beyond the range, so prefixes are right at the borders.
Equal suffixes are merged within a run before the exchange, so a passage that any share of all documents
holds meets once a run, and its places, which the run alone shows to be repeats, do not go there. Texts are
never shuffled: they are written once with a number for each row, and what was found in a part of some
thousand rows lies in a file of the shared folder, which the next pass over these rows reads.

Cases: a null text is empty; texts under 200 bytes lose nothing; matches never cross documents; rows that
repeat a doc_id or a text are documents of their own, so a text that stands twice loses every byte that
a window covers; null doc_ids are kept; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestock.llm.common import give_back, mapped, part_of, read_part, saved, scratch, shuffle_parts, sliced, texts, with_row, write_parts
from lodestock.llm.rolling import mixed, powers, prefix_sums

WINDOW, GRAM = 200, 64
#: Distances from a window's start to its anchor.
SPREAD = WINDOW - GRAM
#: Bytes of text hashed at a time; items of one sorted run; rows sampled for splitters.
SLICE, RUN, SAMPLED = 1 << 19, 20_000, 20_000
#: Items a range of the merge should have at least.
RANGE = 2000
#: Bytes of text whose hashes make up a bucket, and whose items a range of the first merge, about.
BUCKET_BYTES, RANGE_BYTES = 64 << 20, 16 << 20
#: Hashes of a part that are held before their repeats are sent on.
HASHES = 1 << 19
LOW = np.uint64((1 << 24) - 1)
ROWS = "kind int, node int, c1 int, c2 int, part long, uid long, pos long, cover binary"


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window start, and hash of each item of texts that lie in a row."""
    n, width = len(data), SPREAD + 1
    if n < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    power, inverse = powers(n)
    total = prefix_sums(data.astype(np.uint64), power)
    h = mixed((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1])
    order = np.full(-(-len(h) // width) * width, ~np.uint64(0))
    order[: len(h)] = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)  # the smallest hash, then the leftmost
    blocks = order.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    starts = n - WINDOW + 1
    anchor = (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & LOW).astype(np.int64)
    inside = np.zeros(n + 1, np.int64)
    long = at[1:] - at[:-1] >= WINDOW
    np.add.at(inside, at[:-1][long], 1)
    np.add.at(inside, at[1:][long] - WINDOW + 1, -1)
    s = np.flatnonzero(np.cumsum(inside)[:starts])
    if not len(s):
        return anchors(data[:0], at[:1])
    anchor = anchor[s]
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (s[1:] != s[:-1] + 1)])
    last = np.r_[first[1:], len(s)] - 1
    return anchor[first], s[first], s[last], h[anchor[first]]


def slices(batches: Iterator[pa.RecordBatch], piece: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets, uid of each text, part, place of the bytes in the text), with every window of every text once.

    The columns are text, part and uid. A text longer than two pieces comes in pieces that overlap by a window less one.
    """
    for batch in sliced(batches, most=piece):
        parts = np.asarray(batch.column(1))
        for part in np.unique(parts).tolist():
            rows = batch.filter(pa.array(parts == part))
            data, at = texts(rows)
            uid = np.asarray(rows.column(2))
            if len(data) <= 2 * piece or rows.num_rows > 1:
                yield data, at, uid, part, 0
            else:
                for begin in range(0, len(data) - WINDOW + 1, piece):
                    cut = data[begin : begin + piece + WINDOW - 1]
                    yield cut, np.array([0, len(cut)]), uid, part, begin


def nodes(level: int) -> tuple[list[tuple[int, int]], bool, list[list[int]]]:
    """Ranges of distances in a round, whether it looks to the right, and each range's ranges in the next round."""
    out = [(0, SPREAD)]
    for _ in range(max(0, level - 2)):
        out = [half for a, b in out for half in ([(a, (a + b) // 2), ((a + b) // 2 + 1, b)] if a < b else [(a, b)])]
    if level < 2:
        return out, level % 2 == 0, [[0]]
    below, n = [], 0
    for a, b in out:
        below.append([n, n + 1] if a < b else [n])
        n += len(below[-1])
    return out, level % 2 == 0, below


def make_key(node: int, d1: int, d2: int, c1: int, c2: int, cover: bytes, right: bool) -> bytes:
    """Range, core, one side outwards, the other side outwards, and the distances: cover begins c2 before the anchor and ends WINDOW - c1 behind it."""
    left, core, rest = cover[: c2 - d1][::-1], cover[c2 - d1 : c2 + WINDOW - d2], cover[c2 + WINDOW - d2 :]
    return b"".join((bytes((node,)), core, rest, left, bytes((c1, c2))) if right else (bytes((node,)), core, left, rest, bytes((c1, c2))))


def cover_of(key: bytes, d1: int, d2: int, right: bool) -> tuple[int, int, bytes]:
    """c1, c2 and cover of a key."""
    c1, c2 = key[-2:]
    at = 1 + WINDOW - (d2 - d1)
    side = (d2 - c1) if right else (c2 - d1)
    near, far = key[at : at + side], key[at + side : -2]
    left, rest = (far, near) if right else (near, far)
    return c1, c2, left[::-1] + key[1:at] + rest


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` bytes are known to agree."""
    n = min(len(a), len(b))
    while known < n:
        end = min(known + 48, n)
        x, y = a[known:end], b[known:end]
        if x != y:
            return end - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) // 8
        known = end
    return n


_LENGTHS = struct.Struct("<QQ??")


def front_code(keys: list[bytes], weights: list[int], ids: list[list[tuple[int, int, int]]], low: bool, high: bool) -> bytes:
    """A sorted run's part: prefix lengths, rests, weights and ids; low, high: whether its first and last stand for what lies beyond."""
    prefix = [0, *(common_prefix(a, b, 0) for a, b in zip(keys, keys[1:], strict=False))]
    rests = [k[p:] for k, p in zip(keys, prefix, strict=True)]
    flat = [x for row in ids for x in row]
    arrays = [
        np.array(prefix, "<u2"), np.array(list(map(len, rests)), "<u2"), np.minimum(weights, 255).astype("u1"), np.array(list(map(len, ids)), "<u4"),
        *(np.array([x[k] for x in flat], "<i8") for k in range(3)),
    ]
    return zstandard.compress(_LENGTHS.pack(len(keys), len(flat), low, high) + b"".join(a.tobytes() for a in arrays) + b"".join(rests), 1)


class Run:
    """A front-coded run, decoded a suffix at a time."""

    def __init__(self, data: bytes) -> None:
        raw = zstandard.decompress(data)
        self.n, flat, self.low, self.high = _LENGTHS.unpack_from(raw)
        at = _LENGTHS.size
        got = []
        for kind, n in (("<u2", self.n), ("<u2", self.n), ("u1", self.n), ("<u4", self.n), ("<i8", flat), ("<i8", flat), ("<i8", flat)):
            got.append(np.frombuffer(raw, kind, n, at))
            at += got[-1].nbytes
        self.prefix, self.rest, self.weights = got[0].tolist(), got[1].tolist(), got[2].tolist()
        ends = np.cumsum(got[3])
        self.begin, self.end = (ends - got[3]).tolist(), ends.tolist()
        self.owners = list(zip(*(g.tolist() for g in got[4:]), strict=True))
        self.raw, self.at, self.i, self.key = raw, at, -1, b""
        self.step()

    def step(self) -> int:
        """On to the next suffix (key is None after the last); how many bytes it shares with the one before."""
        self.i += 1
        if self.i >= self.n:
            self.key = None
            return 0
        p, n = self.prefix[self.i], self.rest[self.i]
        self.key = self.key[:p] + self.raw[self.at : self.at + n]
        self.at += n
        return p

    def guard(self) -> bool:
        return (self.low and self.i == 0) or (self.high and self.i == self.n - 1)

    def ids(self) -> list[tuple[int, int, int]]:
        return self.owners[self.begin[self.i] : self.end[self.i]]


def merge(runs: list[Run]) -> Iterator[tuple[Run, int]]:
    """The run whose current suffix comes next, and that suffix's common prefix with the one put out before.

    shared[i] is run i's common prefix with the last output. Of two suffixes the one that shares more with
    it comes first, with no byte compared; if they share as much, they are compared from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    keys = [r.key for r in runs] + [None] * (size - len(runs))
    shared, loser = [0] * size, [0] * size

    def play(i: int, j: int) -> tuple[int, int]:
        a, b = keys[i], keys[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if shared[i] != shared[j]:
            return (i, j) if shared[i] > shared[j] else (j, i)
        n = common_prefix(a, b, shared[i])
        if n == len(a) or (n < len(b) and a[n] < b[n]):
            shared[j] = n
            return i, j
        shared[i] = n
        return j, i

    winners = list(range(size))
    level = size
    while level > 1:
        level //= 2
        played = [play(winners[2 * k], winners[2 * k + 1]) for k in range(level)]
        loser[level : 2 * level] = [p[1] for p in played]
        winners = [p[0] for p in played]
    w = winners[0]
    while keys[w] is not None:
        yield runs[w], shared[w]
        shared[w] = runs[w].step()
        keys[w] = runs[w].key
        node = (w + size) // 2
        while node:
            w, loser[node] = play(w, loser[node])
            node //= 2


def settle(runs: list[Run], level: int) -> Iterator[tuple]:
    """Rows (kind, node, c1, c2, part, uid, pos, cover) of a merged range: kind 0 repeats, kind 1 goes on; pos -1: only there to be compared with."""
    ranges, right, below = nodes(level)
    ahead = nodes(level + 1)[0]

    def close(group: list[list]) -> Iterator[tuple]:
        # group: classes [key, prefix with the class before, weight, ids, guard] that share a core
        node = group[0][0][0]
        d1, d2 = ranges[node]
        core = 1 + WINDOW - (d2 - d1)
        for key, _, weight, ids, guard in group:
            if weight > 1 and not guard:
                for owner in ids:
                    yield 0, 0, key[-2], key[-1], *owner, None
        if d1 == d2 or len(group) == 1 or not any(g[4] or (g[2] == 1 and g[3]) for g in group):
            return
        for k, (key, before, weight, ids, guard) in enumerate(group):
            if guard:
                continue
            c1, c2, cover = cover_of(key, d1, d2, right)
            best = max(before if k else 0, group[k + 1][1] if k + 1 < len(group) else 0) - core
            low, high = (max(c1, d2 - best), c2) if right else (c1, min(c2, d1 + best))
            owner = ids[0] if weight == 1 and ids else (0, 0, -1)
            for child in below[node]:
                a, b = max(low, ahead[child][0]), min(high, ahead[child][1])
                if a <= b:
                    yield 1, child, a, b, *owner, cover[c2 - b : WINDOW + c2 - a]

    group: list[list] = []
    for run, shared in merge(runs):
        key, guard = run.key, run.guard()
        if group and shared == len(key) == len(group[-1][0]):
            last = group[-1]
            last[2] += run.weights[run.i]
            last[3] = last[3] + run.ids() if not guard else last[3]
            last[4] = last[4] and guard
            continue
        if group:
            d1, d2 = ranges[group[0][0][0]]
            if shared < 1 + WINDOW - (d2 - d1):
                yield from close(group)
                group = []
        group.append([key, shared, run.weights[run.i], [] if guard else run.ids(), guard])
    if group:
        yield from close(group)


def _core(key: bytes, ranges: list[tuple[int, int]]) -> bytes:
    d1, d2 = ranges[key[0]]
    return key[: 1 + WINDOW - (d2 - d1)]


def _runs(keys: list[bytes], ids: list[tuple[int, int, int]], splitters: list[bytes], level: int) -> Iterator[tuple[int, bytes]]:
    """(range, front-coded part) of the sorted run of keys; an id with pos -1 is none.

    Keys that stand twice in the run are repeats whatever other runs hold: their ids are not exchanged with
    them but go, as (c1, c2, part, uid, pos), to a negative range of the run's own.
    """
    order = sorted(range(len(keys)), key=keys.__getitem__)
    ranges = nodes(level)[0]
    names, weights, own = [], [], []
    for k in order:
        if not names or keys[k] != names[-1]:
            names.append(keys[k])
            weights.append(0)
            own.append([])
        weights[-1] += 1
        if ids[k][2] >= 0:
            own[-1].append(ids[k])
    sure = [(*names[k][-2:], *i) for k, w in enumerate(weights) if w > 1 for i in own[k]]
    if sure:
        yield -1 - hash(sure[0]) % (1 << 40), np.array(sure, "<i8").tobytes()
        own = [[] if w > 1 else i for w, i in zip(weights, own, strict=True)]

    def meets(splitter: bytes, at: int) -> bool:
        """Whether the splitter lies within a core, and the suffix at `at` has that core."""
        core = _core(splitter, ranges)
        return len(splitter) > len(core) and 0 <= at < len(names) and names[at].startswith(core)

    begin = 0
    for r in range(len(splitters) + 1):
        end = bisect.bisect_left(names, splitters[r], begin) if r < len(splitters) else len(names)
        low, high = r > 0 and meets(splitters[r - 1], begin - 1), r < len(splitters) and meets(splitters[r], end)
        a, b = begin - low, end + high
        if a < b:
            yield r, front_code(names[a:b], weights[a:b], own[a:b], low, high)
        begin = end


def _splitters(sample: list[bytes], ranges: int, level: int) -> list[bytes]:
    """Keys that cut the sample evenly: the beginnings of cores, and where one core takes several, keys within it."""
    sample = sorted(set(sample))
    cuts, made = nodes(level)[0], set()
    for k in range(1, ranges if sample else 1):
        key = sample[k * len(sample) // ranges]
        core = _core(key, cuts)
        made.add(key if core in made else core)
    return sorted(made)


def _blobs(parts: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    rows = list(parts)
    return pa.RecordBatch.from_pydict({"range": pa.array([r for r, _ in rows], pa.int64()), "run": pa.array([b for _, b in rows], pa.binary())})


def _merged(runs: DataFrame, level: int) -> DataFrame:
    kinds = [pa.int32()] * 4 + [pa.int64()] * 3 + [pa.binary()]
    names = [f.split()[0] for f in ROWS.split(", ")]

    def settled(table: pa.Table) -> pa.Table:
        if table["range"][0].as_py() < 0:
            sure = np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 5) for x in table["run"].to_pylist()])
            zero = np.zeros(len(sure), np.int32)
            cols = [zero, zero, sure[:, 0], sure[:, 1], *sure.T[2:], [None] * len(sure)]
        else:
            rows = list(settle([Run(x.as_py()) for x in table["run"]], level))
            cols = list(zip(*rows, strict=True)) or [()] * 8
        out = pa.table({n: pa.array(c, t) for n, c, t in zip(names, cols, kinds, strict=True)})
        give_back()
        return out

    return saved(runs.groupBy("range").applyInArrow(settled, ROWS), f"suffixes-{level}", "zstd")


def repeated_ranges(rows: DataFrame, path: str) -> None:
    """Find all windows that repeat; write per part the ranges of their starts: uid of the text, first, last.

    rows: text, part, uid (the number of the row).
    """
    spark = rows.sparkSession
    n_docs, n_bytes = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    parts = shuffle_parts(spark)
    buckets, ranges = (max(parts, (n_bytes or 0) // size + 1) for size in (BUCKET_BYTES, RANGE_BYTES))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(part: int) -> pa.RecordBatch:
            # a hash that stands twice in what is held is named twice
            kinds, n = np.unique(np.concatenate(held), return_counts=True)
            bucket = (kinds >> np.uint64(24)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            kinds, n, bucket = kinds[order], n[order], bucket[order]
            heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            raw = [np.repeat(kinds[a:b], np.minimum(n[a:b], 2)).tobytes() for a, b in zip(heads, np.r_[heads[1:], len(bucket)], strict=True)]
            return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[heads]), "part": pa.array(np.full(len(heads), part)), "hashes": pa.array(raw, pa.binary())})

        now = None
        for data, at, _, part, _ in slices(batches):
            if held and (part != now or sum(map(len, held)) >= HASHES):
                yield flush(now)
                held = []
            now, found = part, anchors(data, at)[3]
            if len(found):
                held.append(found)
        if held:
            yield flush(now)

    def repeats(table: pa.Table) -> pa.Table:
        raw = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
        part = np.repeat(np.asarray(table["part"]), list(map(len, raw)))
        every = np.concatenate(raw)
        kinds, where, n = np.unique(every, return_inverse=True, return_counts=True)
        keep = n[where] > 1
        pairs = np.unique(np.stack([part[keep], every[keep].view(np.int64)], 1), axis=0)
        out = pa.table({"part": pa.array(pairs[:, 0]), "hash": pa.array(pairs[:, 1])})
        give_back()
        return out

    known = f"{path}/hashes"
    found = mapped(rows, hashes, "bucket long, part long, hashes binary").groupBy("bucket").applyInArrow(repeats, "part long, hash long")
    if not write_parts(found, known, ("hash",)):
        return

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int, int, bytes]]:
        now, own = None, np.zeros(0, np.uint64)
        for data, at, uids, part, begin in slices(batches):
            if part != now:
                now, own = part, np.sort(read_part(known, part, 1)[0].view(np.uint64))
            anchor, first, last, h = anchors(data, at)
            if not len(anchor) or not len(own):
                continue
            keep = own[np.minimum(np.searchsorted(own, h), len(own) - 1)] == h
            anchor, first, last = anchor[keep], first[keep], last[keep]
            doc = np.searchsorted(at, anchor, "right") - 1
            raw = data.tobytes()
            for a, s, t, u, p in zip(anchor.tolist(), first.tolist(), last.tolist(), uids[doc].tolist(), (anchor - at[doc] + begin).tolist(), strict=True):
                yield part, u, p, a - t, a - s, raw[s : t + WINDOW]

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [make_key(0, 0, SPREAD, c1, c2, cover, True) for k, (_, _, _, c1, c2, cover) in enumerate(items(batches)) if k % 8 == 0]
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary())})

    def first_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids = [], []
        for part, uid, pos, c1, c2, cover in items(batches):
            keys.append(make_key(0, 0, SPREAD, c1, c2, cover, True))
            ids.append((part, uid, pos))
            if len(keys) >= RUN:
                yield _blobs(_runs(keys, ids, splitters, 0))
                keys, ids = [], []
        yield _blobs(_runs(keys, ids, splitters, 0))

    # splitters only balance the ranges: about 2000 documents are looked at for them
    thin = max(1, n_docs // 2000)
    sample = mapped(rows.filter(F.pmod(F.xxhash64("uid"), F.lit(thin)) == 0), sampled, "key binary").limit(SAMPLED).toArrow()
    splitters = _splitters(sample["key"].to_pylist(), min(ranges, SAMPLED // 2), 0)
    out = _merged(mapped(rows, first_runs, "range long, run binary"), 0)
    done = [out.filter("kind = 0")]
    level = 1
    while level <= 11 and not (left := out.filter("kind = 1").select("node", "c1", "c2", "part", "uid", "pos", "cover")).isEmpty():
        out = _round(left, level, parts)
        done.append(out.filter("kind = 0"))
        level += 1
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    write_parts(every.select("part", "uid", (F.col("pos") - F.col("c2")).alias("first"), (F.col("pos") - F.col("c1")).alias("last")), f"{path}/ranges", ("uid", "first", "last"))


def _round(left: DataFrame, level: int, parts: int) -> DataFrame:
    ranges, right, _ = nodes(level)

    def keys_of(batch: pa.RecordBatch) -> list[bytes]:
        node, c1, c2, cover = (batch.column(k).to_pylist() for k in (0, 1, 2, 6))
        return [make_key(n, *ranges[n], a, b, c, right) for n, a, b, c in zip(node, c1, c2, cover, strict=True)]

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys_of(batch), pa.binary())})

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids = [], []
        for batch in batches:
            keys += keys_of(batch)
            ids += zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True)
            if len(keys) >= RUN:
                yield _blobs(_runs(keys, ids, splitters, level))
                keys, ids = [], []
        yield _blobs(_runs(keys, ids, splitters, level))

    total = left.count()
    thin = max(1, total // (SAMPLED // 4))
    sample = mapped(left.filter(F.pmod(F.xxhash64("cover", "node"), F.lit(thin)) == 0), sampled, "key binary").limit(SAMPLED).toArrow()
    splitters = _splitters(sample["key"].to_pylist(), max(1, min(parts, total // RANGE)), level)
    return _merged(mapped(left, form, "range long, run binary"), level)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (binary)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = with_row(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")), "texts", "uid")
    rows = rows.select("doc_id", "text", part_of(F.col("uid")).alias("part"), "uid")
    path = scratch(docs.sparkSession, "suffixes")
    repeated_ranges(rows.select("text", "part", "uid"), path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.zeros((3, 0), np.int64)
        for batch in sliced(batches, most=2 << 20):
            data, at = texts(batch)
            removed, spans, kept = [], [], []
            for k, (part, uid) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if part != now:
                    now, own = part, read_part(f"{path}/ranges", part, 3)
                a, b = np.searchsorted(own[0], uid, "left"), np.searchsorted(own[0], uid, "right")
                raw = data[at[k] : at[k + 1]]
                if a == b:
                    removed.append(0)
                    spans.append(0)
                    kept.append(raw.tobytes())
                    continue
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, own[1, a:b], 1)
                np.add.at(edge, own[2, a:b] + WINDOW, -1)
                gone = np.cumsum(edge)[:-1] > 0
                removed.append(int(gone.sum()))
                spans.append(int((gone[1:] & ~gone[:-1]).sum()) + int(gone[:1].sum()))
                kept.append(raw[~gone].tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": pa.array(at[1:] - at[:-1]), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return mapped(rows, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
