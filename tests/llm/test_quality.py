import random

import numpy as np

from lodestock.llm import quality
from lodestock.llm.quality import BITS, SCALE, SHARES, Ordinal, bearing, cuts, features, fit_given, fit_ordinal, likelihood, minimize, score_quality, select_quality, train

WORDS = ["".join(random.Random(k).choices("abcdefghij", k=6)) for k in range(300)]
BAD = ["zzvile", "zzawful"]


def flat(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def make(rng, kind):
    words = rng.choices(WORDS, k=rng.randrange(20, 200))
    if kind == 0:
        for _ in range(1 + len(words) // 25):
            words[rng.randrange(len(words))] = rng.choice(BAD)
    if kind == 1:
        words = [w for w in words[:12] for _ in range(8)] if rng.random() < 0.5 else [w + "$$$" for w in words]
    return " ".join(words)


def test_features():
    doc, slot, value = features(*flat(["", "Ab ab\nAB ab!!", "  ", "ab", "é É"]))
    rows = [dict(zip(slot[doc == k].tolist(), value[doc == k].tolist(), strict=True)) for k in range(5)]
    word = (set(rows[3]) - {0, 1, 2}).pop()
    assert rows[0] == {0: 0, 1: 0, 2: 0} == rows[2] and rows[1][word] == 1
    assert [rows[1][k] / SCALE for k in range(3)] == [3 / 5, 1 / 5, 1 / 5]
    assert len(rows[1]) == 3 + 2 and min(k for k in rows[1] if k >= SHARES) >= SHARES
    one = features(*flat(["ab cd " * 1000]))
    assert len(one[0]) == 5


def test_thresholds_are_ordered_and_ranks_learned():
    rng = np.random.default_rng(1)
    x = rng.normal(size=600)
    grade = np.digitize(x + 0.2 * rng.normal(size=600), [-0.5, 0.7])
    model = fit_ordinal(np.arange(600), np.zeros(600, int), x, grade)
    assert model.thresholds[0] < model.thresholds[1]
    tails = model.tails(model.weights[0] * x)
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert np.corrcoef(tails.sum(1), grade)[0, 1] > 0.9


def test_held_out_documents(spark):
    rng = random.Random(4)
    kinds = [rng.choice([0, 1, 2, 2]) for _ in range(900)]
    rows = [(k, make(rng, kind)) for k, kind in enumerate(kinds)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows] + [(None, "  ", "s"), (2000, None, "s"), (2001, "", "s"), (3, rows[3][1], "s")], "doc_id long, text string, kept string")
    labels = [(k, int(kinds[k] != 1), int(kinds[k] == 0)) for k in range(0, 900, 2)] + [(0, int(kinds[0] != 1), int(kinds[0] == 0)), (7777, 1, 0), (2, None, 1), (None, 1, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = train(docs, labels)
    assert isinstance(model, Ordinal)
    out = {r.doc_id: r for r in score_quality(docs, model).collect()}
    right = sum(out[k]._kept == (kinds[k] == 2) for k in range(1, 900, 2))
    assert right / 450 > 0.95
    mean = [np.mean([out[k]._expected_grade for k in range(1, 900, 2) if kinds[k] == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    kept = select_quality(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r._kept}
    assert train(docs, labels.limit(0)) is None
    assert select_quality(docs, labels.limit(0)).count() == docs.count()
    assert select_quality(docs.limit(0), labels).count() == 0


def sparse(rng, n=80, slots=6):
    """Rows of a random problem: document, slot, value, grade."""
    dense = rng.normal(size=(n, slots)) * (rng.random((n, slots)) < 0.5)
    grade = np.digitize(dense @ np.arange(slots) / 3 + rng.logistic(size=n), [-1.0, 1.0])
    doc, slot = np.nonzero(dense)
    return doc, slot, dense[doc, slot], grade, dense


def test_fit_is_that_of_a_plain_optimiser():
    """Against dense gradient descent on the same likelihood, written out per document."""
    rng = np.random.default_rng(3)
    doc, slot, value, grade, dense = sparse(rng)
    ridge, weight = 0.01, (1 / np.bincount(grade))[grade] / 3

    def loss(p):
        score, theta = dense @ p[:6], np.r_[-np.inf, p[6], p[6] + np.exp(p[7]), np.inf]
        cdf = lambda x: 1 / (1 + np.exp(-x))
        return -sum(w * np.log(cdf(theta[g + 1] - s) - cdf(theta[g] - s)) for w, g, s in zip(weight, grade, score, strict=True)) + ridge / 2 * (p[:6] ** 2).sum()

    def slope(p, h=1e-6):
        return np.array([(loss(p + h * e) - loss(p - h * e)) / (2 * h) for e in np.eye(8)])

    x = np.r_[np.zeros(6), -1.0, 0.0]
    f = likelihood(doc, slot, value, grade, 6, 3, ridge)
    for at in (x, rng.normal(size=8)):
        assert abs(f(at)[0] - loss(at)) < 1e-9 and np.abs(f(at)[1] - slope(at)).max() < 1e-6
    own = minimize(f, x, tolerance=1e-12)
    step = 2.0
    for _ in range(600):
        g = slope(x)
        while loss(x - step * g) > loss(x) and step > 1e-6:
            step /= 2
        x = x - step * g
    assert abs(loss(own) - loss(x)) < 1e-6 and np.abs(own - x).max() < 1e-2
    use = np.zeros(SHARES + (1 << BITS), bool)
    use[:6] = True
    model = fit_given(doc, slot, value, grade, use, 3, ridge)
    assert np.abs(model.weights[:6] - own[:6]).max() < 1e-2 and np.abs(model.thresholds - cuts(own, 6)).max() < 1e-2


def test_few_labels_still_teach_words():
    rng = random.Random(11)
    kinds = [k % 3 for k in range(60)]
    doc, slot, value = features(*flat([make(rng, k) for k in kinds]))
    model = fit_ordinal(doc, slot, value, np.array(kinds))
    bad = [features(*flat([w]))[1][-1] for w in BAD]
    assert all(model.weights[b] < 0 for b in bad) and (model.weights != 0).sum() > SHARES
    others = [make(rng, k % 3) for k in range(300)]
    data, at = flat(others)
    kept = model.tails(model.scores(data, at))[:, 1] >= quality.KEEP
    assert kept[2::3].mean() > 0.9 and kept[0::3].mean() < 0.2


def test_a_word_counts_by_how_many_words_are_looked_at():
    """The same shares of grades among twice the documents: the bound stays, the evidence doubles."""
    rng = np.random.default_rng(2)
    grade = np.repeat([0, 2], 50)
    doc, slot = np.nonzero(rng.random((100, 40)) < 0.3)
    slot = slot + SHARES
    doc, slot = np.r_[doc, np.flatnonzero(grade == 0)], np.r_[slot, np.full(50, SHARES + 50)]
    once = bearing(doc, slot, grade, 3, SHARES + 60)
    twice = bearing(np.r_[doc, doc + 100], np.r_[slot, slot], np.r_[grade, grade], 3, SHARES + 60)
    assert once[SHARES + 50] > 1 and (once[SHARES : SHARES + 40] < 1.5).all()
    assert np.allclose(twice, 2 * once)


def test_odd_rows(spark, monkeypatch):
    rng = random.Random(5)
    kinds = [k % 3 for k in range(90)]
    rows = [(k, make(rng, kind), "n", 1.0) for k, kind in enumerate(kinds)] + [(4, make(rng, 0), "n", 1.0), (4, make(rng, 2), "n", 1.0), (500, "long " * 40_000, "n", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept string, _score double")
    labels = spark.createDataFrame([(k, int(kinds[k] != 1), int(kinds[k] == 0)) for k in range(90)] + [(500, 1, 0)], "doc_id long, quality int, toxic int")
    one, two = train(docs, labels), train(docs.repartition(5), labels)
    assert np.array_equal(one.weights, two.weights)  # of the texts of one doc_id always the same
    kept = select_quality(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)
    monkeypatch.setattr(quality, "MOST_FEATURES", 300)
    assert isinstance(train(docs, labels), Ordinal)
    monkeypatch.setattr(quality, "MOST_FEATURES", 0)
    assert train(docs, labels) is None
