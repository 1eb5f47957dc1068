import random

import numpy as np
import pytest

from lodestock.llm import simhash, similar
from lodestock.llm.similar import cross_pairs, one_of_each, prefix, radius, shingle_sets, similar_groups
from tests.llm.test_simhash import slow_print


def slow_groups(texts, words=5, similarity=0.8):
    """Groups by brute force over all pairs: sets of shingles at this Jaccard similarity or more, equal sets too. Labels are places in texts; the number of similar pairs further apart than the radius is the second result."""
    sets = []
    for t in texts:
        found = t.encode().lower().split()
        sets.append({b" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))} if found else set())
    label, apart = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                apart += (slow_print(texts[i], words) ^ slow_print(texts[j], words)).bit_count() > radius(similarity)
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label, apart


def edited(rng, base, spots, word=None):
    copy = list(base)
    for at in spots:
        copy[at] = word or f"e{rng.randrange(10**6)}"
    return " ".join(copy)


def corpus(rng):
    """Small groups of few edits, pairs at a similarity near the limit, a third of all rows near copies of one text that are often not similar to each other, and texts that share a passage."""
    texts = [None, "", " \t", "one", "One", "a b c", "A  b C", "a b a b a b a b", "a b a b a b a b a b"]
    for _ in range(30):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([8, 60, 200]))]
        texts += [edited(rng, base, rng.sample(range(len(base)), rng.choice([0, 1, 2, 4]))) for _ in range(rng.choice([1, 2, 6]))]
    for _ in range(70):
        base = [f"v{rng.randrange(5000)}" for _ in range(200)]
        texts += [" ".join(base), edited(rng, base, rng.sample(range(5, 195, 8), rng.choice([2, 3, 4, 5])), "x")]
    base = [f"h{rng.randrange(3000)}" for _ in range(150)]
    texts += [" ".join(base), *(edited(rng, base, [k, 149 - k // 2]) for k in range(150))]
    passage = [f"p{k}" for k in range(40)]
    texts += [" ".join([*passage, *(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([2, 30])))]) for _ in range(40)]
    rng.shuffle(texts)
    return texts


def test_radius():
    assert radius(0.8) == 10 and radius(1.0) == 0


@pytest.mark.parametrize("chunk", [16])
def test_groups_take_all_similar_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr("lodestock.llm.simhash.CHUNK", chunk)  # so that keys are cut into chunks
    monkeypatch.setattr(similar, "COUNTED", 2)
    monkeypatch.setattr(similar, "LISTED", chunk)
    rng = random.Random(4)
    texts = corpus(rng)
    label, apart = slow_groups([t or "" for t in texts])
    assert apart > 20 and len(set(label)) < len(texts) - 100
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, texts[3])], "doc_id long, text string")
    least = {}
    for r in similar_groups(docs).collect():
        least.setdefault(r.component, []).append(r.first)
    kept = sorted(map(min, least.values()))
    assert kept == sorted(set(label))
    out = one_of_each(docs.withColumn("first", docs.text).withColumn("_first", docs.text).withColumn("_nth", docs.text)).collect()
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == kept and sum(r.doc_id is None for r in out) == 1
    assert all(r.text == r.first for r in out)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "x " * 60_000), (2, "x " * 59_999), (2, "y"), (2, "y"), (None, None), (None, None)], "doc_id long, text string")
    out = sorted(one_of_each(docs).collect(), key=str)
    assert sorted((str(r.doc_id), len(r.text or "")) for r in out) == [("1", 120_000), ("2", 1), ("None", 0), ("None", 0)] or sorted(str(r.doc_id) for r in out) == ["1", "2", "None", "None"]
    assert similar_groups(docs.limit(0)).count() == 0 and one_of_each(docs.filter("doc_id is null")).count() == 2


def test_a_near_copy_group_is_not_paired_out(monkeypatch):
    """Pairs of one component are left out, and what is held is bounded."""
    n = 3000
    none = np.zeros(n, np.int64)
    cols = lambda component: [np.arange(n), component, np.full(n, 50), none, none, none]
    assert list(cross_pairs(none, cols(none), 0.8)) == []
    monkeypatch.setattr(similar, "HELD", 1000)
    parts = list(cross_pairs(none, cols(np.r_[np.zeros(n - 2, int), 5, 6]), 0.8))
    assert sum(len(u) for u, _ in parts) == 2 * (n - 2) + 1 and max(len(u) for u, _ in parts) < 2000


def test_bounds_at_a_meeting_place_drop_no_similar_pair():
    rng = random.Random(6)
    kept = 0
    for _ in range(400):
        a = {rng.getrandbits(60) for _ in range(rng.randrange(1, 60))}
        b = {x for x in a if rng.random() < rng.choice([0.99, 0.9, 0.6])} | {rng.getrandbits(60) for _ in range(rng.choice([0, 1, 4, 20]))}
        if not b:
            continue
        x, y = sorted(a), sorted(b)
        sets = [np.array(v, np.uint64) for v in (x, y)]
        words = [similar.parities(v) for v in sets]
        assert sum(int(np.bitwise_count((p ^ q).view(np.uint64))) for p, q in zip(*words, strict=True)) <= len(a ^ b)
        places = [(x.index(k), y.index(k)) for k in a & b]
        rows = [(g, g_side, (x, y)[g_side], at[g_side]) for g, at in enumerate(places) for g_side in (0, 1)]
        if not rows:
            continue
        group = np.array([r[0] for r in rows])
        side = np.array([r[1] for r in rows])
        cols = [side, side, np.array([len(r[2]) for r in rows]), np.array([r[3] for r in rows]), np.array([words[s][0] for s in side]), np.array([words[s][1] for s in side])]
        found = sum(len(u) for u, _ in cross_pairs(group, cols, 0.8))
        if len(a & b) >= 0.8 * len(a | b):
            kept += 1
            assert found
        elif len(a & b) < 0.3 * len(a | b):
            assert not found
    assert kept > 100


def test_prefixes_of_similar_sets_meet():
    rng = random.Random(2)
    common = np.array(sorted(rng.getrandbits(60) for _ in range(30)), np.uint64)
    counts = np.array([rng.randrange(2, 9) for _ in common])
    for _ in range(300):
        a = {rng.getrandbits(60) for _ in range(rng.randrange(1, 40))} | set(rng.sample(common.tolist(), 10))
        b = {x for x in a if rng.random() < 0.95} | {rng.getrandbits(60) for _ in range(rng.choice([0, 1, 3]))}
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        if len(a & b) >= 0.8 * len(a | b):
            assert set(prefix(x, common, counts, 0.8)[0].tolist()) & set(prefix(y, common, counts, 0.8)[0].tolist())


def test_shingle_sets():
    got = list(shingle_sets(["", "a b", "a b c d e", "a b c d e f", "q q q q q q q"], 5))
    assert [len(s) for s in got] == [0, 1, 1, 2, 1]


def test_the_index_finds_all_pairs_within_the_radius(spark, monkeypatch):
    """Without stars and prefixes, groups are those of similar pairs whose fingerprints differ in the radius or less: neighbours in Gray order alone miss some."""
    monkeypatch.setattr("lodestock.llm.simhash.CHUNK", 8)
    monkeypatch.setattr(similar, "GROUPED", 2, raising=False)  # so that patterns are cut into chunks
    rng = random.Random(8)
    texts = corpus(rng)
    sets, prints = [set(s.tolist()) for s in shingle_sets([t or "" for t in texts], 5)], [slow_print(t or "", 5) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or (prints[i] ^ prints[j]).bit_count() <= radius(0.8) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    none = spark.createDataFrame([], "u long, v long")
    monkeypatch.setattr(similar, "star_pairs", lambda *_: none)
    monkeypatch.setattr(similar, "prefix_pairs", lambda *_: none)
    least = {}
    for r in similar_groups(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect():
        least.setdefault(r.component, []).append(r.first)
    assert sorted(map(min, least.values())) == sorted(set(label))


def test_near_pairs_are_given_once():
    rng = random.Random(3)
    masks, bases = np.array(simhash.patterns(1 << 18, 10), np.uint64), [rng.getrandbits(64) for _ in range(8)]
    prints = [rng.choice(bases) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for _ in range(150)]
    size, component = [rng.choice([50, 60, 70]) for _ in prints], [-rng.randrange(60) for _ in prints]
    rows = sorted((m, p & m, k) for k, p in enumerate(prints) for m in masks.tolist())
    group = np.cumsum([0, *(a[:2] != b[:2] for a, b in zip(rows, rows[1:]))])
    node = np.array([k for _, _, k in rows])
    cols = [node, np.array(component)[node], np.array(size)[node], np.array(prints, np.uint64).view(np.int64)[node], np.array([m for m, _, _ in rows], np.uint64).view(np.int64)]
    got = [(u, v) for us, vs in similar.near_pairs(group, cols, masks, 10, 0.8, step=500) for u, v in zip(us.tolist(), vs.tolist(), strict=True)]
    near = [(i, j) for j in range(150) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 10 and component[i] != component[j] and min(size[i], size[j]) >= 0.8 * max(size[i], size[j])]
    assert len(masks) == 66 and len(near) > 300 and sorted(got) == sorted(near)


def test_pairs_that_parities_rule_out_do_not_leave_the_index():
    """Around a group of copies many prints are near and few sets are similar: the pairs given are those that can be, and all that are."""
    rng = random.Random(9)
    base = [rng.getrandbits(60) for _ in range(150)]
    sets = [np.array(sorted([*rng.sample(base, 150 - e), *(rng.getrandbits(60) for _ in range(e))]), np.uint64) for e in [5] * 60 + [35] * 60]
    node, n = np.arange(len(sets)), len(sets)
    words = np.array([[*similar.parities(s), *similar.half_parities(s)] for s in sets])
    cols = [node, node, np.array([len(s) for s in sets]), np.zeros(n, np.int64), np.zeros(n, np.int64), *words.T]
    got = [(u, v) for us, vs in similar.near_pairs(np.zeros(n, np.int64), cols, np.zeros(1, np.uint64), 10, 0.8) for u, v in zip(us.tolist(), vs.tolist(), strict=True)]
    shared = {(i, j): len(np.intersect1d(sets[i], sets[j])) for j in range(n) for i in range(j)}
    alike = {p for p, both in shared.items() if both >= 0.8 * (300 - both)}
    assert alike == set(got) & alike and len(got) < len(alike) + 0.05 * n * n / 2 and len(alike) < 0.3 * n * n / 2
    i, j = (np.array(x) for x in zip(*shared, strict=True))
    assert (similar.uncommon(list(words.T), i, j) <= 300 - 2 * np.array(list(shared.values()))).all()


def test_rows_of_the_index_search_around_a_group_of_copies(spark, monkeypatch):
    """Texts near a group of copies and not similar to it: no table holds their pairs with the whole group."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    texts = [edited(rng, base, rng.sample(range(150), e)) for e in [1] * 80 + [6] * 80]
    made, search = [], similar._searched

    def counted(*args):
        rows = similar.saved(search(*args), "counted")
        made.append(rows.count())
        return rows

    monkeypatch.setattr(similar, "_searched", counted)
    label, _ = slow_groups(texts)
    least = {}
    for r in similar_groups(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect():
        least.setdefault(r.component, []).append(r.first)
    assert sorted(map(min, least.values())) == sorted(set(label)) and len(least) > 40
    assert made[0] < 2 * len(texts), made
