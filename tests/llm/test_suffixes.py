import hashlib
import random

import numpy as np
import pytest

import lodestock.llm.suffixes as suffixes
from lodestock.llm.suffixes import Run, _runs, _splitters, anchors, common_prefix, cover_of, front_code, make_key, merge, nodes, remove_repeats


def brute(texts, window=200):
    seen = {}
    for t in texts:
        for s in range(len(t) - window + 1):
            seen[t[s : s + window]] = seen.get(t[s : s + window], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - window + 1):
            if seen[t[s : s + window]] > 1:
                gone[s : s + window] = True
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(t)))
        out.append((len(t), int(gone.sum()), int(spans), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def test_prefixes_and_codes():
    assert common_prefix(b"abc", b"abd", 0) == 2 and common_prefix(b"ab", b"abd", 1) == 2 and common_prefix(b"x" * 300, b"x" * 299 + b"y", 3) == 299
    keys = sorted({bytes(random.Random(k).choices(b"ab", k=k % 9 + 1)) for k in range(200)})
    run = Run(front_code(keys, [1] * len(keys), [[(k, 1, 2)] if k % 3 else [] for k in range(len(keys))], False, True))
    got = []
    while run.key is not None:
        got.append((run.key, run.ids(), run.guard()))
        run.step()
    assert got == [(k, [(i, 1, 2)] if i % 3 else [], i == len(keys) - 1) for i, k in enumerate(keys)]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16])
def test_loser_tree(n):
    rng = random.Random(n)
    lists = [sorted({bytes(rng.choices(b"ab", k=rng.randrange(1, 12))) for _ in range(rng.randrange(1, 40))}) for _ in range(n)]
    last, got = b"", []
    for run, shared in merge([Run(front_code(x, [1] * len(x), [[] for _ in x], False, False)) for x in lists]):
        assert shared == common_prefix(last, run.key, 0)
        last = run.key
        got.append(last)
    assert got == sorted(k for x in lists for k in x)


def test_keys_keep_their_cover():
    cover = bytes(range(256)) * 2
    for level in range(12):
        ranges, right, below = nodes(level)
        assert len(below) == len(ranges) or level < 2
        for node, (d1, d2) in enumerate(ranges):
            for c1, c2 in {(d1, d2), (d1, d1), (d2, d2), ((d1 + d2) // 2, d2)}:
                own = cover[: 200 + c2 - c1]
                key = make_key(node, d1, d2, c1, c2, own, right)
                assert cover_of(key, d1, d2, right) == (c1, c2, own)
    assert nodes(10)[0] == [(d, d) for d in range(137)]


def test_anchors_name_every_window():
    rng = random.Random(5)
    raw = [bytes(rng.choices(b"abcd ", k=n)) for n in (150, 200, 201, 0, 900)] + [b"ab" * 300]
    anchor, first, last, _ = anchors(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    starts = [s for a, b in zip(first, last, strict=True) for s in range(a, b + 1)]
    at = np.cumsum([0, *map(len, raw)])
    assert starts == [s for k, t in enumerate(raw) for s in range(at[k], at[k] + len(t) - 199)]
    assert all(0 <= a - t and a - s <= 136 for a, s, t in zip(anchor, first, last, strict=True))


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghé", k=rng.randrange(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passages = [text(n) for n in (40, 60, 90, 200)]
    docs = [text(rng.randrange(1, 200)) for _ in range(30)]
    for _ in range(60):
        kind = rng.randrange(4)
        if kind == 0:
            docs.append(rng.choice(docs))
        elif kind == 1:
            docs.append(text(rng.randrange(30)) + rng.choice(passages) + text(rng.randrange(30)))
        elif kind == 2:
            d = list(rng.choice(docs))
            for _ in range(rng.randrange(4)):
                if d:
                    d[rng.randrange(len(d))] = rng.choice("xyz")
            docs.append("".join(d))
        else:
            d = rng.choice(passages)
            a = rng.randrange(len(d))
            docs.append(text(3) + d[a : a + rng.randrange(150, 420)] + text(3))
    return [*docs, "ab " * 300, "ab " * 200, "z" * 700, "z" * 199, None, "", "q" * 200, "q" * 200]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_removed_bytes_are_those_of_brute_force(spark, seed, monkeypatch):
    if seed > 1:  # short runs, many ranges, pieces of long texts
        monkeypatch.setattr(suffixes, "RANGE", 5)
        monkeypatch.setattr(suffixes, "RUN", 37)
        monkeypatch.setattr(suffixes.slices, "__defaults__", (700,))
    texts = corpus(seed)
    docs = spark.createDataFrame([(k if k else None, t, "p") for k, t in enumerate(texts)], "doc_id long, text string, part string").repartition(3)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(docs).collect())
    assert got == [(k, *w) for k, w in enumerate(brute([(t or "").encode() for t in texts]))]


def test_hot_core_is_cut(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "RANGE", 3)
    monkeypatch.setattr(suffixes, "RUN", 50)
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefgh ", k=230))
    texts = ["".join(rng.choices("abc ", k=200)) + passage + "".join(rng.choices("abc ", k=200)) for _ in range(150)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(docs).collect())
    assert got == [(k, *w) for k, w in enumerate(brute([t.encode() for t in texts]))]
    keys = sorted(make_key(0, 0, 136, 0, 136, (t.encode() * 2)[:336], True) for t in texts[:20])
    same = [keys[0][:-2] + bytes((a, 136)) for a in range(60)]
    cuts = _splitters(same + keys, 12, 0)
    assert len(cuts) == 11 and any(len(c) > 65 for c in cuts) and len(list(_runs(same, [(0, 0, 1)] * 60, cuts, 0))) > 3


def test_no_rows_and_no_repeats(spark):
    docs = spark.createDataFrame([(1, "short"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in remove_repeats(docs).collect()) == [(1, 5, 0), (2, 0, 0)]
    assert remove_repeats(docs.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"
