import math

import numpy as np
import pytest

from lodestock.llm import ann
from lodestock.llm.ann import fit, nearest, score_block


def brute(rows, step, k):
    out = {}
    for i, v in rows:
        if i % step == 0:
            own = sorted((-float(np.dot(v, w)), j) for j, w in rows if j != i)
            out[i] = [(j, -s) for s, j in own[:k]]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(k, (centres[k % 12] + 0.4 * rng.normal(size=16)).astype(np.float32).astype(float)) for k in range(1500)]
    rows += [(2000 + k, rows[3][1]) for k in range(700)]  # a group of equal vectors
    table = [(i, v.tolist(), "x") for i, v in rows]
    table += [(5001, None, "x"), (5002, [0.0] * 16, "x"), (5003, [], "x"), (5004, [math.nan] * 16, "x"), (5005, [None] + [1.0] * 15, "x"), (5006, [math.inf] * 16, "x"), (None, [1.0] * 16, "x"), (5020, [1.0] * 3, "x")]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, score string")
    got = {}
    for r in nearest(df, "vec_id % 20 = 0", 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows, 20, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    vectors = dict(rows)
    for q, found in got.items():
        assert found == sorted(found, key=lambda p: (-p[1], p[0])) and all(abs(s - vectors[q] @ vectors[j]) < 1e-9 for j, s in found)
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 0.5]), (2, [2.0, 0.5])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df, "vec_id % 20 = 0", 20).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 3.0), (0, 2, 2, 3.0)]
    assert nearest(df.limit(0), "vec_id % 20 = 0", 20).count() == 0
    assert nearest(df.limit(1), "vec_id % 20 = 0", 20).count() == 0


def test_repeated_ids_and_other_lengths(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.5]), (4, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df, "vec_id % 20 = 0", 3).collect())
    first = [(0, 1, 20, 1.0), (0, 2, 20, 1.0), (0, 3, 3, 0.5)]
    second = [(0, 1, 3, 0.5), (0, 2, 0, 0.0), (0, 3, 20, 0.0)]
    twin = [(20, 1, 0, 1.0), (20, 2, 20, 1.0), (20, 3, 3, 0.5)]
    assert got == sorted(first + second + twin * 2)


@pytest.fixture
def small_sample(monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 600)
    monkeypatch.setattr(ann, "EACH", 8)


def test_recall_through_the_lists_alone(spark, small_sample, monkeypatch):
    """The table is larger than the sample, so its rows do not help: without the lists there is no answer."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 32)) * 2
    x = np.concatenate([centres[np.arange(3500) % 40] + 0.5 * rng.normal(size=(3500, 32)), centres[0] + 0.05 * rng.normal(size=(1500, 32))])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, "vec_id % 20 = 0", 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    want = {k: set(np.argsort(-score[k])[:20].tolist()) for k in range(0, len(x), 20)}
    assert all(len(got[k]) == 20 for k in want)
    assert sum(len(got[k] & want[k]) for k in want) / (20 * len(want)) >= 0.9
    coarse, probes = ann.fitted(ann.usable(df).selectExpr("*", "vec_id as row"), len(x), 32, 20)
    assert probes < len(coarse.centroids) / 2
    monkeypatch.setattr(ann, "score_block", lambda *a: (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)))
    assert nearest(df, "vec_id % 20 = 0", 20).count() == 0


def test_every_query_gets_all_it_asked_for(spark, small_sample):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 32))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x / np.linalg.norm(x, axis=1)[:, None])], "vec_id long, embedding array<float>")
    got = nearest(df, "vec_id % 20 = 0", 20, probes=1).groupBy("query_id").count().collect()
    assert len(got) == 150 and all(r["count"] == 20 for r in got)


def test_block_of_near_vectors_loses_none():
    rng = np.random.default_rng(7)
    for noise in (0.02, 0.1, 0.3):
        x = rng.normal(size=(1200, 64))
        x[:900] = x[0] + noise * rng.normal(size=(900, 64)) / 8
        coarse = fit(x[rng.permutation(1200)[:400]], 3)
        lists = coarse.lists(x.astype(np.float32))
        ids = np.flatnonzero(lists == np.bincount(lists).argmax())
        q, of = x[ids[:50]], ids[:50]
        codes = coarse.codes(x[ids].astype(np.float32), lists[ids])
        query, found, _ = score_block(coarse, lists[ids[0]], of, q, ids, codes, x[ids], 20, 40, np.full(50, -np.inf))
        for k, own in enumerate(of):
            score = x[ids] @ q[k]
            score[ids == own] = -np.inf
            assert set(ids[found[query == k]].tolist()) == set(ids[np.argsort(-score)[:20]].tolist())
