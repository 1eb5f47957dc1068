"""Fits with residual classes, terms of some traits, large models, residual types and checks, each against a dense or closed form."""

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

import lodestock.operators.mixed as mx
from lodestock.operators import chains as ch
from lodestock.operators import checks, selection
from lodestock.operators.likelihood import LevelLikelihood, Likelihood, dense_neg2logl, likelihood
from lodestock.operators.pedigree import Family
from lodestock.plans import design as ds
from lodestock.plans.formula import parse
from lodestock.sources import read_plink_raw, read_snp_lines
from tests.test_models import CALVES, ped_of


def records(spark, n=40, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(str(4 + k % 5), f"c{rng.integers(3)}", f"r{rng.integers(2)}", float(rng.normal()), float(rng.normal() + 3), float(rng.normal() * 2) if rng.random() < 0.8 else None, float(rng.uniform(0.5, 2))) for k in range(n)]
    return spark.createDataFrame(rows, "id string, c string, r string, x double, y double, z double, w double"), rows


def dense_parts(rows, fam, classes=("c0", "c1", "c2")):
    x = np.array([[1, *(r[1] == c for c in classes[1:]), r[3]] for r in rows], float)
    z = np.zeros((len(rows), len(fam)))
    for k, r in enumerate(rows):
        z[k, fam.place[r[0]]] = 1
    return x, z @ fam.relationship(fam.ids) @ z.T, z


def lik_of(spark, formula, df, fam, **more):
    design = ds.build(df, parse(formula), fam.ids, **more)
    return Likelihood(design, ds.statistics(design), [fam.inverse() if g.relationship else None for g in design.groups])


def slopes(lik, at):
    out = []
    for k in range(len(at)):
        up, down = np.array(at), np.array(at)
        up[k], down[k] = up[k] + 1e-5, down[k] - 1e-5
        out.append((lik.value(up) - lik.value(down)) / 2e-5)
    return out


def test_residual_classes_against_the_dense_route(spark):
    df, rows = records(spark)
    fam = Family(ped_of(spark, *CALVES))
    lik = lik_of(spark, "y ~ c + cov(x) + animal(id)", df, fam, residual_by="r")
    assert lik.names == ["var(animal)", "var(residual|r0)", "var(residual|r1)"]
    x, k, _ = dense_parts(rows, fam)
    at = [0.4, 0.7, 1.6]
    v = 0.4 * k + np.diag([0.7 if r[2] == "r0" else 1.6 for r in rows])
    assert lik.value(np.array(at)) == pytest.approx(dense_neg2logl(np.array([r[4] for r in rows]), x, v), abs=1e-8)
    assert lik.evaluate(np.array(at)).score.tolist() == pytest.approx(slopes(lik, at), abs=1e-4)
    one = lik_of(spark, "y ~ c + cov(x) + animal(id)", df, fam)
    assert lik.value(np.array([0.4, 1.0, 1.0])) == pytest.approx(one.value(np.array([0.4, 1.0])), abs=1e-9)
    fit = mx.model("y ~ c + cov(x) + random(id)", df, residual_by="r")
    share = [sum(r[2] == c for r in rows) / len(rows) for c in ("r0", "r1")]
    theta = fit.theta
    assert fit.converged and mx.phenotypic_variance(fit) == pytest.approx(theta["var(id)"] + share[0] * theta["var(residual|r0)"] + share[1] * theta["var(residual|r1)"])
    for bad in ({"residual_by": "r", "weights": "w"}, {"residual_by": "lost"}):
        with pytest.raises(ValueError):
            mx.model("y ~ c", df, **bad)
    with pytest.raises(ValueError, match="one class"):
        mx.model("y ~ c", df.withColumn("r", F.lit("a")), residual_by="r")


def test_terms_of_some_traits_against_the_dense_route(spark):
    df, rows = records(spark)
    fam = Family(ped_of(spark, *CALVES))
    lik = lik_of(spark, "cbind(y, z) ~ c + cov(x, traits='z') + animal(id) + random(c, name='pen', traits='y')", df, fam)
    assert lik.names == ["var(animal@y)", "cov(animal@z,animal@y)", "var(animal@z)", "var(pen@y)", "var(res@y)", "cov(res@z,res@y)", "var(res@z)"]
    at = np.array([0.9, 0.3, 0.7, 0.5, 1.1, 0.2, 1.2])
    x, k, _ = dense_parts(rows, fam)
    seen = [(i, t) for i, r in enumerate(rows) for t in (0, 1) if r[4 + t] is not None]
    c, r0 = np.array([[0.9, 0.3], [0.3, 0.7]]), np.array([[1.1, 0.2], [0.2, 1.2]])
    v = np.array([[c[s, t] * k[i, j] + (0.5 if s == t == 0 and rows[i][1] == rows[j][1] else 0) + r0[s, t] * (i == j) for j, t in seen] for i, s in seen])
    wide = np.array([np.r_[x[i, :3] * (t == 0), x[i] * (t == 1)] for i, t in seen])
    assert lik.value(at) == pytest.approx(dense_neg2logl(np.array([rows[i][4 + t] for i, t in seen]), wide, v), abs=1e-8)
    assert lik.evaluate(at).score.tolist() == pytest.approx(slopes(lik, at), abs=1e-4)
    # no covariance between traits: the sum of two fits of one trait
    at = np.array([0.9, 0, 0.7, 0.5, 1.1, 0, 1.2])
    a = lik_of(spark, "y ~ c + animal(id) + random(c, name='pen')", df, fam).value(np.array([0.9, 0.5, 1.1]))
    b = lik_of(spark, "z ~ c + cov(x) + animal(id)", df, fam).value(np.array([0.7, 1.2]))
    assert lik.value(at) == pytest.approx(a + b, abs=1e-8)


@pytest.mark.parametrize("weights", [None, "w"])
def test_residual_types_are_the_dense_ones(spark, weights):
    df, rows = records(spark)
    ped = ped_of(spark, *CALVES)
    fam = Family(ped)
    fit = mx.model("y ~ c + cov(x) + animal(id)", df, ped, start={"var(animal)": 0.7, "var(residual)": 1.3}, most=0, weights=weights, checks=False)
    got = {(r.id, r.x): r for r in mx.residuals(fit, df, weights).collect()}
    w = np.array([r[6] if weights else 1.0 for r in rows])
    x, k, _ = dense_parts(rows, fam)
    r = np.diag(1.3 / w)
    v = 0.7 * k + r
    vi = np.linalg.inv(v)
    p = vi - vi @ x @ np.linalg.inv(x.T @ vi @ x) @ x.T @ vi
    e, var = r @ p @ np.array([q[4] for q in rows]), np.diag(r @ p @ r)
    for k, q in enumerate(rows):
        own = got[q[0], q[3]]
        assert own.residual == pytest.approx(e[k], abs=1e-8) and own.pearson == pytest.approx(e[k] * math.sqrt(w[k] / 1.3), abs=1e-8)
        assert own.standardized == pytest.approx(e[k] / math.sqrt(var[k]), abs=1e-7) and own.leverage == pytest.approx(1 - var[k] * w[k] / 1.3, abs=1e-8)


def test_a_lone_record_has_no_standardized_residual(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0)], "c string, y double")
    fit = mx.model("y ~ c", df, start={"var(residual)": 1.0}, most=0)
    out = {r.y: r for r in mx.residuals(fit, df).collect()}
    assert out[1.0].leverage == pytest.approx(1.0) and out[1.0].standardized is None and out[2.0].standardized == pytest.approx(-0.5 / math.sqrt(0.5))


def test_a_large_model_has_the_solutions_of_a_small_one(spark, monkeypatch):
    ped = ped_of(spark, *CALVES)
    df, _ = records(spark)
    formula, start = "y ~ c + cov(x) + rn(id, base=c(one, x), name='rn') + pe(id)", {"var(rn[0])": 20.0, "cov(rn[1],rn[0])": 3.0, "var(rn[1])": 8.0, "var(pe_id)": 2.0, "var(residual)": 40.0}
    df = df.withColumn("one", F.lit(1.0))
    small = mx.model(formula, df, ped, start=start, most=0)
    want = {(r.id, r.term): r.ebv for r in mx.solutions(small).collect()}
    fixed = {r.effect: r.estimate for r in small.coefficients().collect()}
    monkeypatch.setattr(mx, "DRIVER_COLUMNS", 3)
    for here in (0, 10**6):
        monkeypatch.setattr("lodestock.operators.linear.DRIVER_ENTRIES", here)
        monkeypatch.setattr(mx, "conjugate_gradients", lambda *a, here=here: __import__("lodestock.operators.linear", fromlist=["x"]).conjugate_gradients(*a, here=here))
        large = mx.model(formula, df, ped, start=start, most=0, tolerance=1e-12)
        assert isinstance(large, mx.LargeFit)
        got = {(r.id, r.term): r.ebv for r in mx.solutions(large).collect()}
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-7) for k in want)
        assert {r.effect: r.estimate for r in large.coefficients().collect()} == pytest.approx(fixed, abs=1e-7)
        assert [r.term for r in mx.solutions(large, "pe_id").limit(1).collect()] == ["pe_id"]
    with pytest.raises(ValueError):
        mx.model("cbind(y, z) ~ random(id)", df, start={}, most=0, checks=False)


def test_cells_paired_there_and_here(spark, monkeypatch):
    df, _ = records(spark)
    f = parse("cbind(y, z) ~ c + cov(x) + cov(x, nested='r') + random(id)".replace("cov(x, nested='r')", "cov(w, nested='r')"))
    design = ds.build(df, f)
    here = ds.statistics(design)
    monkeypatch.setattr(ds, "DRIVER_CELLS", 0)
    there = ds.statistics(design)
    assert set(here) == set(there) and len(here) == 2
    for m in here:
        assert here[m].n == there[m].n and np.allclose(here[m].ww, there[m].ww) and np.allclose(here[m].wy, there[m].wy) and np.allclose(here[m].yy, there[m].yy)


def test_what_a_fit_refuses_or_warns_of(spark):
    rows = [(f"h{k % 6}", f"s{k % 3}", str(4 + k % 5), float(k % 7), 5.0, float(k), 1.0, 2.0) for k in range(30)]
    df = spark.createDataFrame(rows, "herd string, sire string, id string, y double, flat double, x double, one double, two double")
    ped = ped_of(spark, *CALVES)
    with pytest.raises(ValueError, match="nested"):
        mx.model("y ~ herd + random(sire)", df)
    with pytest.raises(ValueError, match="no variance"):
        mx.model("flat ~ herd", df)
    with pytest.raises(ValueError, match="single level"):
        mx.model("y ~ random(g)", df.withColumn("g", F.lit("a")))
    with pytest.raises(ValueError, match="depend"):
        mx.model("y ~ rn(id, base=c(one, two))", df, ped)
    with pytest.raises(ValueError, match="collinear"):
        mx.model("cbind(y, y2) ~ random(herd)", df.withColumn("y2", F.col("y") * 2 + 1))
    with pytest.raises(ValueError, match="nothing to estimate"):
        mx.model("y ~ x", df.limit(3).withColumn("x", F.col("x").cast("string")), checks=False)
    with pytest.warns(UserWarning, match="nested"):
        mx.model("y ~ herd + random(sire)", df, start={"var(sire)": 1.0, "var(residual)": 1.0}, most=0)
    with pytest.warns(UserWarning, match="more than one record"):
        mx.model("y ~ animal(id)", df, ped, start={"var(animal)": 1.0, "var(residual)": 1.0}, most=0)
    with pytest.warns(UserWarning, match="3 levels"):
        mx.model("y ~ random(sire)", df, start={"var(sire)": 1.0, "var(residual)": 1.0}, most=0)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        mx.model("y ~ animal(id) + pe(id)", df, ped, start={"var(animal)": 1.0, "var(pe_id)": 1.0, "var(residual)": 1.0}, most=0)
    geno = spark.createDataFrame([(f"a{k}", f"m{j}", (k * j + j) % 3 if (k, j) != (1, 1) else None) for k in range(4) for j in range(5)], "id string, marker string, dosage int")
    with pytest.raises(ValueError, match="call rate"):
        checks.check_genotypes(geno)
    with pytest.warns(UserWarning, match="same genotype"):
        checks.check_genotypes(geno, least=0.5)
    with pytest.raises(ValueError, match="two genotypes"):
        checks.check_genotypes(geno.unionByName(geno.limit(1)))
    with pytest.raises(ValueError, match="genotype 7"):
        checks.check_genotypes(geno.unionByName(spark.createDataFrame([("b", "m0", 7)], geno.schema)))


def test_variance_table(spark):
    df, _ = records(spark)
    fit = mx.model("cbind(y, z) ~ c + random(id)", df, start={"var(id@y)": 2.0, "cov(id@z,id@y)": 0.6, "var(id@z)": 1.0, "var(res@y)": 2.0, "cov(res@z,res@y)": 0.5, "var(res@z)": 3.0}, most=0)
    rows = {r.component: r for r in mx.variance_table(fit, "z").collect()}
    assert rows["var(id@z)"].share == pytest.approx(0.25) and rows["var(res@z)"].share == pytest.approx(0.75) and rows["var(id@y)"].share is None
    assert rows["cov(id@z,id@y)"].correlation == pytest.approx(0.6 / math.sqrt(2))


def slow_ess(x):
    """Geyer's sequence as it is written in the literature, a pair at a time."""
    m, n = x.shape
    cov = np.array([[((c[: n - t] - c.mean()) * (c[t:] - c.mean())).sum() / n for t in range(n)] for c in x]).mean(0)
    within = cov[0] * n / (n - 1)
    total = within * (n - 1) / n + (x.mean(1).var(ddof=1) if m > 1 else 0)
    rho = np.zeros(n)
    even, odd, t = 1.0, 1 - (within - cov[1]) / total, 0
    rho[:2] = even, odd
    while t < n - 5 and even + odd > 0:
        t += 2
        even, odd = (1 - (within - cov[t + k]) / total for k in (0, 1))
        if even + odd >= 0:
            rho[t], rho[t + 1] = even, odd
    if even > 0:
        rho[t] = even
    for k in range(2, t - 1, 2):
        if rho[k] + rho[k + 1] > rho[k - 2] + rho[k - 1]:
            rho[k] = rho[k + 1] = (rho[k - 2] + rho[k - 1]) / 2
    return m * n / max(-1 + 2 * rho[: max(t, 1)].sum() + rho[t], 1 / math.log10(m * n))


def test_effective_sizes_are_those_of_the_literature():
    rng = np.random.default_rng(1)
    for n, phi, m in [(200, 0, 4), (200, 0.5, 4), (201, 0.9, 3), (21, 0.3, 4), (100, 0.6, 1), (100, -0.7, 2), *((k, 0.3, 4) for k in range(5, 13))]:
        x = rng.normal(size=(m, n))
        for k in range(1, n):
            x[:, k] = phi * x[:, k - 1] + math.sqrt(1 - phi**2) * x[:, k]
        assert ch.ess(x) == pytest.approx(slow_ess(x), rel=1e-10)
    heavy, light = rng.standard_t(1.5, size=(4, 2000)), rng.normal(size=(4, 2000))
    assert ch.pareto_k(heavy) > 0.5 > ch.pareto_k(light)
    moved = light + np.array([0, 0, 0, 3])[:, None]
    assert np.nanmin(ch.pairwise_rhat(moved), axis=1)[3] > 1.2 and np.nanmin(ch.pairwise_rhat(light), axis=1).max() < 1.02
    assert ch.mcse_sd(light) == pytest.approx(1 / math.sqrt(2 * 8000), rel=0.2) and math.isnan(ch.ess(np.ones((2, 50))))
    assert ch.boundary_share(np.array([[[1.0, 1.0], [1.0, 1.0]], [[1.0, 0.2], [0.2, 1.0]]])) == 0.5


def test_ranks_over_ranges(spark):
    values = [3.0, 3.0, 1.0, 9.0, 9.0, 9.0, 2.5, -1.0]
    got = sorted((r.v, r.rank_v) for r in selection.ranks(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect())
    assert got == [(-1.0, 8.0), (1.0, 7.0), (2.5, 6.0), (3.0, 4.5), (3.0, 4.5), (9.0, 2.0), (9.0, 2.0), (9.0, 2.0)]
    some = spark.createDataFrame([(1,), (2,), (2,), (3,)], "id int")
    assert sorted(r.id for r in selection.in_all([some, some.filter("id > 1")], some.filter("id = 3")).collect()) == [2]


def test_genotype_lines_are_read_strictly(spark, tmp_path):
    def text(name, lines):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        return str(tmp_path / name)

    good = read_snp_lines(spark, text("good", ["  a1 0125", "", "a2  2210 "])).collect()
    assert sorted((r.id, r.marker, r.dosage) for r in good)[:4] == [("a1", "1", 0), ("a1", "2", 1), ("a1", "3", 2), ("a1", "4", None)] and len(good) == 8
    for name, lines, what in [("three", ["a1 0125", "a2 22 10"], "a2 22 10"), ("lone", ["a1 0125", "a3"], "a3"), ("short", ["a1 0125", "a4 012"], "a4 012")]:
        with pytest.raises(ValueError, match=what):
            read_snp_lines(spark, text(name, lines))
    with pytest.raises(Exception, match="genotype code"):
        read_snp_lines(spark, text("code", ["a1 0129"])).collect()
    head = "FID IID PAT MAT SEX PHENOTYPE m1_A m2_C"
    raw = read_plink_raw(spark, text("ok.raw", [head, "f a 0 0 1 -9 0 NA", "f b 0 0 1 -9 2 1"])).collect()
    assert sorted((r.id, r.marker, r.dosage) for r in raw) == [("a", "m1", 0), ("a", "m2", None), ("b", "m1", 2), ("b", "m2", 1)]
    for bad in ("3", "x", "99"):
        with pytest.raises(Exception, match="genotype code"):
            read_plink_raw(spark, text(f"bad{bad}.raw", [head, f"f a 0 0 1 -9 0 {bad}"])).collect()


def test_quantiles_by_brackets(spark, monkeypatch):
    from lodestock.operators import quality

    rng = np.random.default_rng(5)
    values = np.r_[rng.normal(size=400), np.full(300, 1.5), rng.lognormal(4, 2, 300)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    want = [float(np.quantile(values, p)) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]
    assert quality.quantiles(df, "v", [0.0, 0.25, 0.5, 0.75, 1.0]) == (1000, pytest.approx(want))
    monkeypatch.setattr(quality, "GATHERED", 20)
    monkeypatch.setattr(quality, "BINS", 8)
    assert quality.quantiles(df, "v", [0.0, 0.25, 0.5, 0.75, 1.0]) == (1000, pytest.approx(want))
    row = quality.fences(df, "v").first()
    assert row.n_observed == 1000 and row.q25 == pytest.approx(want[1]) and row.high == pytest.approx(want[3] + 3 * (want[3] - want[1]))
    assert quality.fences(df.limit(0), "v").first().n_observed == 0


def test_gram_over_slices_of_markers(spark):
    from lodestock.operators.genotypes import gram

    z = np.random.default_rng(6).normal(size=(9, 23))
    rows = spark.createDataFrame([(f"a{i}", f"m{j}", float(z[i, j])) for i in range(9) for j in range(23)], "id string, marker string, z double")
    got = {(r.i, r.j): r.x for r in gram(rows, 2.0, block=4, markers=6).collect()}
    assert len(got) == 45 and all(got[f"a{i}", f"a{j}"] == pytest.approx(z[i] @ z[j] / 2) for i in range(9) for j in range(i + 1))
    with pytest.raises(Exception, match="numbers of markers"):
        gram(rows.limit(200), 2.0).collect()


def test_weighted_shares_and_summary(spark):
    df, rows = records(spark)
    fit = mx.model("y ~ random(c)", df, start={"var(c)": 2.0, "var(residual)": 3.0}, most=0, weights="w", checks=False)
    mean = np.mean([1 / r[6] for r in rows])
    assert mx.harmonic_weight(fit) == pytest.approx(1 / mean) and mx.h2(fit) == pytest.approx(2 / (2 + 3 * mean)) and mx.h2(fit, weight=2.0) == pytest.approx(2 / 3.5)
    text = mx.summary(fit)
    assert "not converged" in text and "var(residual)" in text and "40 records" in text


def test_simulated_genotypes_follow_the_pedigree(spark):
    from lodestock.operators.genotypes import marker_stats, parentage_check
    from lodestock.operators.pedigree import pedigree
    from lodestock.sources import simulate_genotypes, simulate_population

    pop = simulate_population(spark, founders=12, generations=2, offspring=20)
    geno = simulate_genotypes(pop, 60)
    assert geno.count() == 52 * 60 and {r.dosage for r in geno.select("dosage").distinct().collect()} == {0, 1, 2}
    pairs = parentage_check(pedigree(pop), geno)
    assert pairs.count() == 80 and pairs.filter("n_opposite > 0").isEmpty()
    assert marker_stats(geno).filter("freq between 0.02 and 0.98").count() > 50


def test_worst_levels(spark):
    draws = spark.createDataFrame([(c, i, f"p{k}", float((i * 7 % 5) + c * k)) for c in range(3) for i in range(40) for k in range(4)], "chain int, iteration int, parameter string, value double")
    assert [r.parameter for r in ch.worst_levels(draws, 2).collect()] == ["p3", "p2"]


@pytest.mark.parametrize("formula, more", [
    ("y ~ c + cov(x) + random(id)", {}),
    ("y ~ c + cov(x) + random(id)", {"weights": "w"}),
    ("y ~ c + random(r) + random(id)", {"residual_by": "r"}),
    ("cbind(y, z) ~ c + cov(x, traits='z') + random(id) + random(r, traits='y')", {}),
    ("cbind(y, z) ~ c + random(id, base=c(one, x))", {}),
    ("cbind(y, z) ~ c + random(id, traits='z')", {}),
])
def test_levels_eliminated_one_by_one_give_what_the_square_matrix_gives(spark, formula, more, monkeypatch):
    df = records(spark, 80)[0].withColumn("id", F.concat("id", F.substring(F.col("w").cast("string"), 4, 1))).withColumn("one", F.lit(1.0))
    f = parse(formula)
    cells = ds.cells_of(df, f, **more)
    apart, whole = ds.laid_out(cells, f), ds.laid_out(cells, f)
    g = cells.apart(f, 100)
    assert f.groups and list(f.groups)[g] == "id"
    monkeypatch.setattr(ds, "DRIVER_CELLS", 20)  # in parts
    ds.level_statistics(apart, g)
    monkeypatch.undo()
    ds.statistics(whole)
    none = [None] * len(whole.groups)
    a, b = likelihood(apart, none), likelihood(whole, none)
    assert isinstance(a, LevelLikelihood) and a.names == b.names
    at = b.start() * np.linspace(0.8, 1.3, len(b.names))
    at = np.where(at == 0, 0.05 * at.max() * np.linspace(0.5, 1, len(at)), at)
    x, y = a.evaluate(at), b.evaluate(at)
    assert a.value(at) == pytest.approx(b.value(at), abs=1e-8) and x.neg2logl == pytest.approx(y.neg2logl, abs=1e-8)
    for name in ("score", "information", "solution", "em"):
        assert np.allclose(getattr(x, name), getattr(y, name), atol=1e-8, rtol=1e-8), name
    got = np.asarray(x.inverse)
    held = np.isfinite(got)
    assert np.allclose(got[held], y.inverse[held], atol=1e-10) and np.allclose(x.inverse.diagonal(), np.diag(y.inverse), atol=1e-10)


def test_components_of_many_levels_need_no_square_matrix(spark, monkeypatch):
    df, rows = records(spark, 120)
    df = df.withColumn("g", F.concat("id", F.substring(F.col("w").cast("string"), 4, 1)))
    want, share = mx.model("y ~ c + cov(x) + random(g)", df).theta, mx.model("y ~ random(g)", df, start={"var(g)": 1.0, "var(residual)": 2.0}, most=0)
    assert mx.h2(share) == pytest.approx(1 / 3)
    monkeypatch.setattr(mx, "DRIVER_COLUMNS", 8)
    monkeypatch.setattr(ds, "DRIVER_COLUMNS", 8)
    fit = mx.model("y ~ c + cov(x) + random(g)", df)
    assert len(fit.design.groups[0].levels) > 8 and fit.theta == pytest.approx(want)
    again = mx.model("y ~ random(g)", df, start={"var(g)": 1.0, "var(residual)": 2.0}, most=0)
    assert mx.h2(again) == pytest.approx(1 / 3)
    for name in ("ebv", "acc"):
        assert {r.id: r[name] for r in mx.solutions(again).collect()} == pytest.approx({r.id: r[name] for r in mx.solutions(share).collect()})


def test_draws_of_many_levels_need_no_square_matrix(spark, monkeypatch):
    """The chain keeps no matrix of levels by levels, and its draws have the means and variances of the equations' solution."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(f"g{k % 30}", float(rng.normal() + k % 30 / 10)) for k in range(150)], "g string, y double")
    monkeypatch.setattr(Likelihood, "equations", lambda *a: pytest.fail("square"))
    theta = {"var(g)": 0.5, "var(residual)": 1.0}
    draws = ch.gibbs("y ~ random(g)", df, n_iter=4000, burnin=0, thin=1, chains=1, theta=theta)
    got = {r.parameter: (r.m, r.v) for r in draws.groupBy("parameter").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v")).collect()}
    fit = mx.model("y ~ random(g)", df, start=theta, most=0)
    sol, pev = fit.walk.evaluation.solution, fit.walk.evaluation.inverse.diagonal()
    for k in range(31):
        m, v = got[f"b[{k}]"]
        assert abs(m - sol[k]) < 5 * math.sqrt(pev[k] / 4000) and v == pytest.approx(pev[k], rel=0.15)


def test_pairs_of_blocks_are_not_sent(spark):
    """Gram matrices read each animal's arrays from the shared folder: no exchange of the plan carries them a second time."""
    from lodestock.operators.genotypes import gram

    rows = spark.createDataFrame([(f"a{i}", f"m{j}", float(i + j)) for i in range(9) for j in range(3)], "id string, marker string, z double")
    found = gram(rows, 2.0, block=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "Generate" not in plan and found.count() == 45


def test_normal_scores_and_moments_of_long_chains(spark, monkeypatch):
    from statistics import NormalDist

    from lodestock.operators import quality

    p = np.r_[np.linspace(1e-12, 1 - 1e-12, 4001), 1e-300, 0.075, 0.925]
    unit = NormalDist()
    assert np.allclose(ch.normal_quantiles(p), [unit.inv_cdf(v) for v in p], rtol=1e-14, atol=1e-15)
    x = np.random.default_rng(3).normal(size=(3, 200)).round(1)
    flat = x.ravel()
    rank = np.array([(flat < v).sum() + ((flat == v).sum() + 1) / 2 for v in flat])
    assert np.allclose(ch._normal_ranks(x).ravel(), [unit.inv_cdf((r - 0.375) / (len(flat) + 0.25)) for r in rank])
    draws = spark.createDataFrame([(c, i, "a", float(x[c, i])) for c in range(3) for i in range(200)], "chain int, iteration int, parameter string, value double")
    monkeypatch.setattr(quality, "GATHERED", 50)
    monkeypatch.setattr(quality, "BINS", 8)
    want = (x.mean(), x.std(ddof=1), *np.quantile(x, (0.05, 0.95)))
    for most in (20, 0):
        r = ch.moments(draws, most=most).first()
        assert (r.mean, r.sd, r.low, r.high) == pytest.approx(want)
    r = ch.diagnostics(draws).first()
    assert (r.mean, r.sd, r.low, r.high) == pytest.approx(want) and r.rhat == pytest.approx(ch.rhat(x)) and r.pareto_k == pytest.approx(ch.pareto_k(x))
