import random

import numpy as np
import pytest
import xxhash

from lodestock.llm.components import components
from lodestock.llm.simhash import CHUNK, GrayIndex, fingerprints, forest_links, gray_rank, patterns, simhash_components


def slow_print(text, words=4):
    found = text.encode().lower().split()
    shingles = [b" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))] if found else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints, most=4):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_fingerprints():
    rng = random.Random(1)
    texts = ["", " ", "one", "a b c", "A b C d", "a b c d e", "É x\x0by\x1cz w q", *(" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(n)) for n in (4, 5, 255, 258, 259, 700))]
    assert fingerprints(texts).tolist() == [slow_print(t) for t in texts]
    assert fingerprints(texts, 5).tolist() == [slow_print(t, 5) for t in texts]
    assert fingerprints([]).tolist() == []


def test_gray_order():
    assert gray_rank(np.array([k ^ k >> 1 for k in range(1000)], np.uint64)).tolist() == list(range(1000))
    for n in (10, 10**7, 10**10):
        masks = patterns(n)
        assert n >> bin(masks[0]).count("1") <= CHUNK
        rng = random.Random(n)
        for _ in range(200):
            diff = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not diff & m for m in masks)


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_every_link(seed):
    rng = random.Random(seed)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        prints.append(rng.choice(prints) ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 3, 4, 5, 6]))))
    group = np.array([rng.randrange(3) for _ in prints])
    x = np.array(prints, np.uint64)
    index = GrayIndex(group, x)
    same = np.arange(len(x))
    i, j = index.near(np.arange(len(x)), 4, same, index.uniform(same))
    got = {tuple(sorted((int(index.order[a]), int(index.order[b])))) for a, b in zip(i, j, strict=True)}
    assert got == {(a, b) for b in range(len(x)) for a in range(b) if group[a] == group[b] and (prints[a] ^ prints[b]).bit_count() <= 4}
    u, v = forest_links(np.zeros(len(x), int), x, np.arange(len(x)) * 10, 4, step=2000)
    label = list(range(len(x)))
    for a, b in zip((u // 10).tolist(), (v // 10).tolist(), strict=True):
        a, b = label[a], label[b]
        label = [min(a, b) if t in (a, b) else t for t in label]
    assert label == slow_components(prints) and len(u) == len(x) - len(set(label))


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 300), (500, 501), (501, 500), (9, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in [*range(41), 300]) and all(got[k] == 100 for k in range(100, 160)) and got[501] == 500
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_documents(spark, monkeypatch):
    import lodestock.llm.simhash as simhash

    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(500)]
    base = [" ".join(rng.choices(vocabulary, k=150)) for _ in range(12)]
    rows = []
    for k in range(220):
        words = rng.choice(base[:1] * 6 + base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((k, " ".join(words)))
    rows += [(400, None), (401, ""), (402, "  \n"), (None, rows[0][1]), (None, "lone words of nobody else at all"), (5, rows[5][1]), (403, "w " * 50_000), (404, "one two"), (405, "ONE  two")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    monkeypatch.setattr(simhash, "CHUNK", 8)  # so that patterns are cut into chunks
    got = simhash_components(docs).collect()
    known = [r for r in rows if r[0] is not None]
    prints = [slow_print(t or "") for _, t in known]
    label = slow_components(prints)
    least = {}
    for (i, _), c in zip(known, label, strict=True):
        least[c] = min(least.get(c, i), i)
    want = sorted((i, f"{p:016x}", least[c]) for (i, _), p, c in zip(known, prints, label, strict=True))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None) == want
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == sorted(["None", str(dict((p, c) for _, p, c in want)[f"{prints[0]:016x}"])])
    assert simhash_components(docs.limit(0)).count() == 0
