import math

import numpy as np
import pytest

import lodestock.operators.linear as la
import lodestock.operators.mixed as mx
import lodestock.operators.pedigree as pg
from lodestock.operators.likelihood import dense_neg2logl
from lodestock.operators.linear import conjugate_gradients, inv_pd, selected_inverse, sparse_cholesky, sparse_solve
from lodestock.operators.mixed import fitted, h2, h2_curve, model, profile, se_function, solutions
from lodestock.operators.pedigree import Family, a22_inverse, a_inverse, blocks, generations, gene_fractions, inbreeding, mendelian_variance, metafounder_relationship, pedigree, pruned, sire_mgs, with_founders
from lodestock.plans.design import build, independent, statistics
from lodestock.plans.formula import parse


def ped_of(spark, sire, dam):
    rows = [(str(k + 1), str(s), str(d)) for k, (s, d) in enumerate(zip(sire, dam, strict=True))]
    return pedigree(spark.createDataFrame(rows, "id string, sire string, dam string"))


CALVES = ([0, 0, 0, 1, 3, 1, 4, 3], [0, 0, 0, 0, 2, 2, 5, 6])


def test_formulas():
    f = parse("cbind(y1, y2) ~ cg + cov(age, nested='herd') + animal(id) + pe(id) + sire(s, mgs=k) + rn(id, base=c(p0, p1), name='curve')")
    assert f.traits == ("y1", "y2") and [t.name for t in f.terms] == ["cg", "age", "animal", "pe_id", "sire", "curve"]
    assert f.groups["curve"][0].base == ("p0", "p1") and f.groups["sire"][0].mgs == "k"
    for bad in ("y ~ a*b", "y ~ 0 + a", "y ~ -a", "y ~ animl(id)", "y ~ animal(id, grp=g)", "y", "y ~ random(a) + random(a)", "y ~ animal(id, id2)"):
        with pytest.raises(ValueError):
            parse(bad)


def test_inbreeding_and_inverse(spark):
    ped = ped_of(spark, [0, 0, 1, 1, 4, 5], [0, 0, 2, 0, 3, 2])
    found = {r.id: (r.f, r.d) for r in inbreeding(ped).collect()}
    assert [round(found[str(k)][0], 6) for k in range(1, 7)] == [0, 0, 0, 0, 0.125, 0.125]
    assert [round(1 / found[str(k)][1], 3) for k in range(1, 7)] == [1, 1, 2, 1.333, 2, 2.133]
    got = {(r.i, r.j): r.x for r in a_inverse(ped).collect()}
    golden = [[1.833], [0.5, 2.033], [-1, -1, 2.5], [-0.667, 0, 0.5, 1.833], [0, 0.533, -1, -1, 2.533], [0, -1.067, 0, 0, -1.067, 2.133]]
    for i, row in enumerate(golden):
        for j, x in enumerate(row):
            assert got.get((str(i + 1), str(j + 1)), 0.0) == pytest.approx(x, abs=6e-4)
    fam = Family(ped)
    a = fam.relationship(fam.ids)
    assert np.allclose(a @ fam.inverse(), np.eye(6)) and np.allclose(a, a.T)
    assert np.allclose(a22_inverse(ped, ["5", "6"]), np.linalg.inv(a[np.ix_([fam.place["5"], fam.place["6"]], [fam.place["5"], fam.place["6"]])]))
    ten = Family(ped_of(spark, [0, 0, 1, 1, 1, 3, 5, 7, 7, 9], [0, 0, 2, 2, 3, 4, 6, 0, 8, 6]))
    assert ten.f[ten.place["7"]] == pytest.approx(0.3125) and ten.f[ten.place["8"]] == 0


def test_grandsires(spark):
    df = spark.createDataFrame([("1", "0", "0"), ("2", "0", "0"), ("3", "0", "0"), ("4", "1", "0"), ("5", "2", "1"), ("6", "3", "2")], "id string, sire string, mgs string")
    ped = sire_mgs(df)
    fam = Family(ped)
    assert [round(float(fam.d[fam.place[str(k)]]), 6) for k in range(1, 7)] == [1, 1, 1, 0.75, 0.6875, 0.6875]
    got = {(r.i, r.j): r.x for r in a_inverse(ped).collect()}
    full = np.zeros((6, 6))
    for (i, j), x in got.items():
        full[int(i) - 1, int(j) - 1] = full[int(j) - 1, int(i) - 1] = x
    order = [fam.place[str(k)] for k in range(1, 7)]
    assert np.allclose(np.linalg.inv(full), fam.relationship(fam.ids)[np.ix_(order, order)])
    with pytest.raises(ValueError):
        sire_mgs(spark.createDataFrame([("1", "0", "0", "0"), ("2", "1", "0", "0"), ("3", "0", "9", "2")], "id string, sire string, mgs string, dam string"), dam="dam")
    rows = spark.range(1).select(mendelian_variance(*[__import__("pyspark.sql.functions", fromlist=["lit"]).lit(x) for x in (0.0, 0.0)], __import__("pyspark.sql.functions", fromlist=["lit"]).lit(True)).alias("d"))
    assert rows.first().d == 11 / 16


def test_pedigree_tables(spark):
    ped = ped_of(spark, *CALVES)
    assert {r.id: r.gen for r in generations(ped).collect()} == {"1": 0, "2": 0, "3": 0, "4": 1, "5": 1, "6": 1, "7": 2, "8": 2}
    ids = spark.createDataFrame([("7",), ("x",), ("0",)], "id string")
    assert {r.id for r in pruned(ped, ids).collect()} == {"1", "2", "3", "4", "5", "7"}
    assert with_founders(ped, ids).count() == 9
    two = ped_of(spark, [0, 0, 1, 0, 0, 4], [0, 0, 2, 0, 0, 5])
    assert {r.id: r.block for r in blocks(two).collect()} == {"1": "1", "2": "1", "3": "1", "4": "4", "5": "4", "6": "4"}
    q = {(r.id, r.group): r.q for r in gene_fractions(ped, spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "b")], "id string, group string")).collect()}
    assert q["6", "a"] == q["6", "b"] == 0.5 and q["8", "b"] == 0.75
    for rows in ([("1", "2", "0"), ("2", "1", "0")], [("1", "9", "0")], [("1", "0", "0"), ("1", "0", "0")]):
        with pytest.raises(ValueError):
            generations(pedigree(spark.createDataFrame(rows, "id string, sire string, dam string")))
    fam = Family(ped)
    assert np.allclose(metafounder_relationship(fam, {}, np.zeros((1, 1))), fam.relationship(fam.ids))
    assert metafounder_relationship(fam, {}, np.array([[0.4]]))[0, 0] == pytest.approx(1.2)


def test_textbook_blup(spark):
    ped = ped_of(spark, *CALVES)
    df = spark.createDataFrame([("4", "M", 4.5), ("5", "F", 2.9), ("6", "F", 3.9), ("7", "M", 3.5), ("8", "M", 5.0)], "id string, sex string, wwg double")
    fit = model("wwg ~ sex + animal(id)", df, ped, start={"var(animal)": 20.0, "var(residual)": 40.0}, most=0)
    rows = {r.id: r for r in solutions(fit).collect()}
    assert [round(rows[str(k)].ebv, 3) for k in range(1, 9)] == [0.098, -0.019, -0.041, -0.009, -0.186, 0.177, -0.249, 0.183]
    assert [round(rows[str(k)].se ** 2 / 40, 3) for k in range(1, 9)] == [0.471, 0.492, 0.456, 0.428, 0.428, 0.442, 0.442, 0.422]
    b = {r.effect: r.estimate for r in fit.coefficients().collect()}
    assert abs(b["sex=F"]) == pytest.approx(b["(Intercept)"] - 3.404 + b["sex=F"], abs=1e-3) or b["(Intercept)"] + b["sex=F"] == pytest.approx(3.404, abs=1e-3)
    assert not fit.converged and h2(fit) == pytest.approx(1 / 3)
    out = {r.id: r for r in fitted(fit, df).collect()}
    assert out["4"].fitted == pytest.approx(4.358 - 0.009, abs=2e-3) and out["4"].residual == pytest.approx(4.5 - out["4"].fitted)


def test_textbook_reml(spark):
    ped = ped_of(spark, *CALVES)
    df = spark.createDataFrame([("4", "M", 2.6), ("5", "F", 0.1), ("6", "F", 1.0), ("7", "M", 3.0), ("8", "M", 1.0)], "calf string, sex string, wwg double")
    at = model("wwg ~ sex + animal(calf)", df, ped, start={"var(animal)": 0.2, "var(residual)": 0.4}, most=0)
    assert at.neg2logl == pytest.approx(4.7704, abs=1e-3)
    assert at.walk.evaluation.score.tolist() == pytest.approx([-2 * 1.2464, -2 * 1.6510], abs=2e-3)
    fit = model("wwg ~ sex + animal(calf)", df, ped)
    assert fit.converged and list(fit.theta.values()) == pytest.approx([0.5514, 0.4835], abs=1e-3)
    assert fit.neg2logl == pytest.approx(4.3634, abs=1e-3) and list(fit.se.values()) == pytest.approx([2.313, 1.563], abs=5e-3)
    value, se = se_function(fit, lambda t: t["var(animal)"])
    assert value == fit.theta["var(animal)"] and se == pytest.approx(2.313, abs=5e-3)
    curve = profile(fit, "var(animal)", [0.2, 0.5514, 1.0])
    assert min(curve, key=lambda p: p[1])[0] == 0.5514
    sires = spark.createDataFrame([("2", 2.9), ("1", 4.0), ("3", 3.5), ("2", 3.5)], "s string, y double")
    simple = model("y ~ sire(s)", sires, ped_of(spark, [0, 0, 0], [0, 0, 0]))
    assert list(simple.theta.values()) == pytest.approx([0.047, 0.163], abs=1e-3)


def test_repeatability(spark):
    ped = ped_of(spark, [0, 0, 0, 1, 3, 1, 3, 1], [0, 0, 0, 2, 2, 5, 4, 7])
    fy = [201, 280, 150, 200, 160, 190, 180, 250, 285, 300]
    df = spark.createDataFrame([(str(4 + k // 2), str(1 + k % 2), h, float(v)) for k, (h, v) in enumerate(zip("1314231324", fy, strict=True))], "id string, parity string, hys string, fy double")
    fit = model("fy ~ parity + hys + animal(id) + pe(id)", df, ped, start={"var(animal)": 20.0, "var(pe_id)": 12.0, "var(residual)": 28.0}, most=0)
    u = {r.id: r.ebv for r in solutions(fit).collect()}
    assert [round(u[str(k)], 3) for k in range(1, 9)] == [10.148, -3.084, -7.063, 13.581, -18.207, -18.387, 9.328, 24.194]
    pe = {r.id: r.ebv for r in solutions(fit, "pe_id").collect()}
    assert [pe[str(k)] for k in range(4, 9)] == pytest.approx([8.417, -7.146, -17.229, -1.390, 17.347], abs=1e-3)


def test_two_traits_against_the_dense_route():
    from lodestock.operators.likelihood import Likelihood, maximize
    from lodestock.plans.design import Design, Group, Statistics

    rng = np.random.default_rng(3)
    n, q = 60, 8
    g = rng.integers(0, q, n)
    y = (rng.normal(size=(q, 2)) @ np.linalg.cholesky([[2.0, 0.8], [0.8, 1.5]]).T)[g] + rng.normal(size=(n, 2))
    lost = rng.random((n, 2)) < 0.2
    w = np.zeros((n, 1 + q))
    w[:, 0] = w[np.arange(n), 1 + g] = 1
    patterns = {}
    for m in {tuple((~lost[k]).tolist()) for k in range(n)} - {(False, False)}:
        own = [k for k in range(n) if tuple((~lost[k]).tolist()) == m]
        yy = np.where(m, y[own], 0)
        patterns[m] = Statistics(w[own].T @ w[own], w[own].T @ yy, yy.T @ yy, len(own))
    design = Design(parse("cbind(y1, y2) ~ random(g)"), ["(Intercept)"], [Group("g", 1, [str(k) for k in range(q)], ["g"], False)], None)
    lik = Likelihood(design, patterns, [None])
    at = np.array([2.0, 0.5, 1.0, 1.0, 0.2, 1.2])
    seen = [(k, t) for k in range(n) for t in (0, 1) if not lost[k, t]]
    c, r = np.array([[2.0, 0.5], [0.5, 1.0]]), np.array([[1.0, 0.2], [0.2, 1.2]])
    v = np.array([[c[s, t] * (g[i] == g[j]) + r[s, t] * (i == j) for j, t in seen] for i, s in seen])
    x = np.array([[t == 0, t == 1] for _, t in seen], float)
    assert lik.value(at) == pytest.approx(dense_neg2logl(np.array([y[k, t] for k, t in seen]), x, v), abs=1e-8)
    score = lik.evaluate(at).score
    for k in range(6):
        up, down = at.copy(), at.copy()
        up[k], down[k] = up[k] + 1e-5, down[k] - 1e-5
        assert score[k] == pytest.approx((lik.value(up) - lik.value(down)) / 2e-5, abs=1e-4)
    best = maximize(lik)
    assert best.converged and np.abs(best.evaluation.score).max() < 1e-2


def test_design_and_rank(spark):
    df = spark.createDataFrame([("a", "x", 1.0, 2.0), ("a", "y", 2.0, 3.0), ("b", "x", 3.0, 5.0), ("b", "y", 4.0, 4.0)], "c string, d string, z double, y double")
    design = build(df, parse("y ~ c + d + cov(z) + random(d, name='r')"))
    s = statistics(design)[(True,)]
    w = np.array([[1, 1, 0, 1, 0, 1, 1, 0], [1, 1, 0, 0, 1, 2, 0, 1], [1, 0, 1, 1, 0, 3, 1, 0], [1, 0, 1, 0, 1, 4, 0, 1]], float)
    assert np.allclose(s.ww, w.T @ w) and np.allclose(s.wy[:, 0], w.T @ [2, 3, 5, 4]) and s.n == 4
    assert independent(s.ww[:6, :6]).tolist() == [True, True, False, True, False, False]
    with pytest.raises(ValueError):
        build(spark.createDataFrame([(None, 1.0)], "c string, y double"), parse("y ~ c"))


def test_linear_algebra(spark):
    rng = np.random.default_rng(1)
    a = np.diag(rng.uniform(4, 6, 12))
    for i, j in [(3, 1), (7, 2), (7, 3), (11, 0), (5, 4), (9, 7)]:
        a[i, j] = a[j, i] = rng.normal()
    entries = {(i, j): a[i, j] for i in range(12) for j in range(i + 1) if a[i, j]}
    for reorder in (True, False):
        factor = sparse_cholesky(12, entries, reorder)
        assert factor.logdet == pytest.approx(np.linalg.slogdet(a)[1])
        assert np.allclose(factor.solve(np.arange(12.0)), np.linalg.solve(a, np.arange(12.0)))
        inverse = np.linalg.inv(a)
        assert all(v == pytest.approx(inverse[i, j], abs=1e-10) for (i, j), v in factor.selected_inverse().items())
    assert np.allclose(inv_pd(a), np.linalg.inv(a))
    triplets = spark.createDataFrame([(i, j, float(v)) for (i, j), v in entries.items()], "i long, j long, x double")
    b = spark.createDataFrame([(k, float(k)) for k in range(12)], "i long, b double")
    want = np.linalg.solve(a, np.arange(12.0))
    assert all(r.x == pytest.approx(want[r.i]) for r in sparse_solve(triplets, b).collect())
    few = a[:4, :4]
    near = np.linalg.solve(few, np.arange(4.0))
    for here in (0, 1000):  # as tables, and on the driver
        x, n, left = conjugate_gradients(triplets.filter("i < 4 and j < 4"), b.filter("i < 4"), 1e-10, here=here)
        assert n <= 4 and left < 1e-10 and all(r.x == pytest.approx(near[r.i], abs=1e-8) for r in x.collect())
    assert selected_inverse(triplets).count() >= len(entries)
    with pytest.raises(ValueError):
        sparse_solve(triplets.unionByName(triplets.selectExpr("j as i", "i as j", "x")), b)
    curve = h2_curve(spark, {"a": np.eye(2), "p": np.eye(1)}, 1.0, "a", 0.0, 10.0, 3).collect()
    assert curve[1].genetic == pytest.approx(0.5) and curve[0].genetic == pytest.approx(2.0) and math.isclose(curve[1].h2, 0.5 / 2)


def test_inbreeding_by_family_is_that_of_the_whole(spark, monkeypatch):
    """Families in parts of two or three animals: inbred ones, half sibs, grandsires, parents without a line, lines of sires only."""
    rows = [("1", None, None, False), ("2", None, None, False), ("3", "1", "2", False), ("4", "1", "2", False), ("5", "3", "4", False), ("6", "5", "4", False), ("7", "5", "9", True), ("9", None, None, False), ("8", "7", "3", True)]
    rows += [("a", None, None, False), ("b", "a", None, False), ("c", "b", None, False), ("d", None, "a", False), ("e", "c", "d", False), ("f", "zz", "a", False), ("g", "f", "a", False)]
    rows += [(f"s{k}", f"s{k // 2}" if k > 1 else None, None, False) for k in range(1, 9)]
    ped = spark.createDataFrame(rows, "id string, sire string, dam string, via_mgs boolean")
    fam = Family(ped)
    monkeypatch.setattr(pg, "FAMILY_ANIMALS", 0)
    monkeypatch.setattr(pg, "PART_ANIMALS", 3)
    monkeypatch.setattr(pg, "DRIVER_ANIMALS", 0)
    got = {r.id: (r.f, r.d) for r in inbreeding(ped).collect()}
    assert set(got) == set(fam.ids) and fam.f.max() > 0.2
    for i, f, d in zip(fam.ids, fam.f, fam.d, strict=True):
        assert got[i] == pytest.approx((f, d), abs=1e-12), i
    loop = spark.createDataFrame([("1", "3", None), ("2", "1", None), ("3", "2", None), ("4", "1", None)], "id string, sire string, dam string")
    with pytest.raises(ValueError, match="cycle"):
        inbreeding(loop)


def test_selected_inverse_by_block_is_that_of_the_whole(spark, monkeypatch):
    triplets = spark.createDataFrame([(f"{k}{i}", f"{k}{j}", x) for k in "pqrstu" for i, j, x in ((1, 1, 3.0 + ord(k) % 5), (2, 2, 4.0), (2, 1, 0.7), (3, 3, 5.0), (4, 3, -1.0), (4, 4, 2.0), (4, 2, 0.3))], "i string, j string, x double")
    want = {(r.i, r.j): r.x for r in selected_inverse(triplets).collect()}
    monkeypatch.setattr(la, "PART_ENTRIES", 5)
    got = {(r.i, r.j): r.x for r in selected_inverse(triplets, here=3).collect()}
    assert got == pytest.approx(want) and len(got) > 30


def test_families_are_solved_one_by_one(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(f"o{k}", f"c{k % 7}", f"h{k % 3}", float(rng.normal()), float(rng.normal())) for k in range(60)]
    df = spark.createDataFrame(rows, "id string, sire string, h string, x double, y double")
    ped = spark.createDataFrame([(r[0], r[1], None) for r in rows] + [(f"c{k}", None, None) for k in range(7)], "id string, sire string, dam string")
    formula, start = "y ~ h + cov(x) + animal(id)", {"var(animal)": 4.0, "var(residual)": 6.0}
    small = model(formula, df, ped, start=start, most=0, checks=False)
    for name, n in (("DRIVER_COLUMNS", 5), ("DRIVER_ENTRIES", 0)):
        monkeypatch.setattr(mx, name, n)
    monkeypatch.setattr(la, "PART_ENTRIES", 20)
    monkeypatch.setattr(mx, "conjugate_gradients", lambda *a: pytest.fail("iterated"))
    large = model(formula, df, ped, start=start, most=0, checks=False)
    for f, key in ((solutions, "id"), (lambda fit: fit.coefficients(), "effect")):
        value = "ebv" if key == "id" else "estimate"
        assert {r[key]: r[value] for r in f(large).collect()} == pytest.approx({r[key]: r[value] for r in f(small).collect()}, abs=1e-9)
