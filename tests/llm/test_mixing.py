import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from lodestock.llm.mixing import GOLDEN, floor_sum, mix, mixed_documents, plan, points_before, schedule, targets, word_counts


def test_floor_sums():
    rng = random.Random(1)
    for _ in range(300):
        n, m, a, b = rng.randrange(60), rng.randrange(1, 90), rng.randrange(200), rng.randrange(-300, 300)
        assert floor_sum(n, m, a, b) == sum((a * i + b) // m for i in range(n))
    points = [i * GOLDEN % 2**64 for i in range(500)]
    for low, high in [(0, 2**64), (2**62, 2**63), (5, 5), (2**63, 2**64)]:
        assert points_before(500, low, high) == sum(low <= p < high for p in points)


def test_targets_fill_up():
    assert targets([]) == [] and targets([0, 0]) == [0, 0]
    got = targets([100, 1000, 10, 0, 50])
    assert sum(got) == pytest.approx(1.5 * 1160) and all(t <= 2 * s + 1e-9 for t, s in zip(got, [100, 1000, 10, 0, 50], strict=True))
    assert got[0] == 200 and got[2] == 20 and got[4] == 100


def test_every_source_gets_its_slots(spark):
    sizes = [1000, 37, 5000, 0, 300]
    goals = targets(sizes)
    p = plan(sizes, goals, 16)
    rows = schedule(spark, p).collect()
    assert len({r.slot for r in rows}) == len(rows) == p["total"]
    for s, words in enumerate(p["words"]):
        own = [r for r in rows if r.source_no == s]
        assert sum(r.words for r in own) == words == min(round(goals[s]), 2 * sizes[s])
        assert len({(r[2], r.block) for r in own}) == len(own)
    first = [r for r in sorted(rows, key=lambda r: r.slot)][: p["total"] // 4]
    share = sum(r.source_no == 2 for r in first) / len(first)
    assert abs(share - p["slots"][2] / p["total"]) < 0.03  # low discrepancy: any stretch has the shares of the whole


def corpus(rng, n):
    rows = [(k, " ".join("w" * rng.randrange(1, 5) + str(k) for _ in range(rng.choice([0, 1, 3, 50, 400]))), "hot" if k % 3 else rng.choice(["a", "b", "é", None])) for k in range(n)]
    return rows + [(1, None, "a"), (None, "x y", "b"), (None, "x y", "b"), (7, "long " * 20_000, "b"), (8, "\x1c a\x0bb c ", None), (3, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2])]


def slow_mix(docs, block):
    """The mix by brute force: every point of the schedule on its own, every word of a source in a list. (doc_id, text, pass) -> slots and words taken, a list for each time the row is there."""
    rows = docs.withColumn("h", F.xxhash64("text")).withColumn("size", F.lit(0).cast("long")).collect()
    size = {r.text: len((r.text or "").encode().split()) for r in rows}
    named = docs.sparkSession.createDataFrame([(r.doc_id, r.text, r.source, r.h, size[r.text]) for r in rows], "doc_id long, text string, source string, h long, size long")
    named = named.withColumn("order", F.xxhash64("doc_id", "h", "size", F.lit("mix")))
    rows = sorted(named.collect(), key=lambda r: r.order)  # fewer rows than a bucket has
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    words = [[(k, w) for k, r in enumerate(rows) if r.source == s for w in range(r["size"])] for s in sources]
    goals = targets(list(map(len, words)))
    limits = [min(round(t), 2 * len(w)) for t, w in zip(goals, words, strict=True)]
    queues = []
    for own, limit in zip(words, limits, strict=True):
        blocks, left, nth = [], limit, 0
        per = [own[k : k + block] for k in range(0, len(own), block)]
        while left:
            blocks.append((nth // len(per), per[nth % len(per)][:left]))
            left -= len(blocks[-1][1])
            nth += 1
        queues.append(blocks)
    bounds = np.cumsum([0, *map(len, queues)]).tolist()
    edges = [(b << 64) // bounds[-1] for b in bounds]
    slots, late = [], 0
    for i in range(bounds[-1]):
        point = i * GOLDEN % 2**64
        s = next(k for k in range(len(sources)) if edges[k] <= point < edges[k + 1])
        slots.append((i, s))
    order = {s: [i for i, t in slots if t == s] for s in range(len(sources))}
    for s, blocks in enumerate(queues):
        for _ in range(len(blocks) - len(order[s])):
            order[s].append(bounds[-1] + late)
            late += 1
    found = {}
    for s, blocks in enumerate(queues):
        for at, (turn, taken) in zip(order[s], blocks, strict=False):
            for k, _ in taken:
                found.setdefault(k, {}).setdefault(turn, []).append(at)
    return rows, found


@pytest.mark.parametrize("block", [16, 300])
def test_mix_is_that_of_brute_force(spark, block):
    docs = spark.createDataFrame([(*r, "z") for r in corpus(random.Random(2), 150)], "doc_id long, text string, source string, target string")
    rows, found = slow_mix(docs, block)
    want = []
    for k, r in enumerate(rows):
        every = [at for turn in found.get(k, {}).values() for at in turn]
        want.append((r.doc_id if r.doc_id is not None else -1, r["size"], len(every), min(every, default=-1), len(set(every))))
    got = mix(docs, block=block).collect()
    plain = sorted((r.doc_id if r.doc_id is not None else -1, r["size"], r.taken, r.first_slot if r.first_slot is not None else -1, r.n_slots) for r in got)
    assert plain == sorted(want)
    assert all((r.slots_digest == 0) == (r.taken == 0) for r in got)
    # the mixed table: each taking in the order of its first slot
    taken = mixed_documents(docs.withColumn("n_chars", F.char_length("text")), block=block).collect()
    times = sorted((min(turn), len(turn), str(rows[k].doc_id), rows[k].text) for k, turns in found.items() for turn in turns.values())
    assert sorted((len(r.text.encode().split()), str(r.doc_id)) for r in taken) == sorted((n, i) for _, n, i, _ in times)
    place, order = {}, []
    for slot, _, i, text in times:
        place.setdefault((i, text), []).append(slot)
    for r in taken:
        if place.get((str(r.doc_id), r.text)):  # a text that was cut is another
            order.append(place[str(r.doc_id), r.text].pop(0))
    assert len(order) > len(taken) - 10 and order == sorted(order)


def test_clashing_names(spark):
    names = ["row", "_row", "slot", "_slot", "begin", "_id", "_hash", "_size", "_taken", "_key", "_nth", "part", "words", "size"]
    rows = corpus(random.Random(3), 40)
    docs = spark.createDataFrame([(*r, *map(str, range(len(names)))) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    assert all([r[n] for n in names] == list(map(str, range(len(names)))) for r in out.collect())
    plain = mixed_documents(docs.drop(*names)).collect()
    assert sorted(map(str, plain)) == sorted(str(r) for r in out.drop(*names).collect())


def test_mix(spark):
    rng = random.Random(2)
    rows = [(k, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.choice([0, 1, 3, 50, 400]))), "hot" if k % 3 else rng.choice(["a", "b", "é", None])) for k in range(400)]
    rows += [(1, None, "a"), (None, "x y", "b"), (None, "x y", "b"), (7, "long " * 20_000, "b"), (8, "\x1c a\x0bb c ", None)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, source string, target string")
    got = mix(docs).collect()
    want = sorted((r[0] if r[0] is not None else -1, len((r[1] or "").encode().split())) for r in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r["size"]) for r in got) == want
    own = {}
    for _, text, source in rows:
        own[source] = own.get(source, 0) + len((text or "").encode().split())
    order = sorted(own, key=lambda s: (s is None, s or ""))
    goals = dict(zip(order, targets([own[s] for s in order]), strict=True))
    by_size = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        by_size[(r.source_size, r.target)] = by_size.get((r.source_size, r.target), 0) + r.taken
    assert {(own[s], goals[s]) for s in order} == set(by_size)
    assert all(abs(taken - target) <= 1 for (_, target), taken in by_size.items())
    again = mix(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mix(docs.limit(0)).count() == 0
    assert np.array([r["size"] for r in word_counts(docs.filter("doc_id = 8 and source is null")).collect()]).max() >= 3
