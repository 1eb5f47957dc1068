import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestock.functions import canonical_label, h2_liability, h2_observed, heat_load, is_missing_label, spelling_key, thi
from lodestock.operators import chains as ch
from lodestock.operators import genotypes as gt
from lodestock.operators import mixed as mx
from lodestock.operators import quality as ql
from lodestock.operators import selection as sl
from lodestock.operators import single_step as ss
from lodestock.operators.pedigree import Family, pedigree
from lodestock.queries import QUERIES
from lodestock.session import shared_folder
from lodestock.sources import read_plink, read_snp_lines, write_plink
from lodestock.streaming import RunningMeans


def test_scales(spark):
    row = spark.range(1).select(thi(F.lit(25.0), F.lit(50.0)).alias("t"), heat_load(F.lit(75.0)).alias("a"), heat_load(F.lit(60.0)).alias("b"), h2_observed("0.1781", "0.234").alias("o"), h2_liability("0.093", "0.234").alias("l")).first()
    assert row.t == pytest.approx(71.775) and (row.a, row.b) == (7, 0) and row.o == pytest.approx(0.093, abs=1e-3) and row.l == pytest.approx(0.178, abs=1e-3)
    with pytest.raises(Exception):
        spark.range(1).select(thi(F.lit(25.0), F.lit(120.0))).collect()


def test_labels(spark):
    df = spark.createDataFrame([(100000.0, " Á 01.0"), (1.5, "NaN"), (None, "NA")], "x double, t string")
    assert [r[0] for r in df.select(canonical_label(df, "x")).collect()] == ["100000", "1.5", None]
    assert [r[0] for r in df.select(is_missing_label(df, "t")).collect()] == [False, True, False]
    assert df.select(spelling_key(F.col("t"))).first()[0] == "a01"


def test_phenotype_checks(spark):
    rng = np.random.default_rng(1)
    rows = [("a" if k % 2 else "b", float(v)) for k, v in enumerate(rng.normal(size=38))] + [("a", 999.0), ("c", -999.0)]
    out = ql.qc_phenotypes(spark.createDataFrame(rows, "cg string, y double"), "y", missing_code=-999.0, classes=("cg",))
    row = out.counts.first()
    assert (row.n_rows, row.n_missing, row.n_outliers) == (40, 1, 1) and out.data.filter("y = -999").count() == 2
    assert [(r.cg, r.n_observed) for r in out.small["cg"].collect()] == [("c", 0)]
    df = spark.createDataFrame([(1.0,), (1.0,)], "y double")
    for bad in (lambda: ql.qc_phenotypes(df, "z"), lambda: ql.qc_phenotypes(df, "y"), lambda: ql.qc_phenotypes(df.selectExpr("'a' as y"), "y"), lambda: ql.qc_phenotypes(df.limit(1), "y")):
        with pytest.raises((ValueError, TypeError)):
            bad()


def test_index_and_drift(spark):
    e = lambda *v: spark.createDataFrame([(f"a{k + 1}", x) for k, x in enumerate(v)], "id string, ebv double")
    got = [(r.id, r["index"]) for r in sl.selection_index([e(2.0, 0.0, -2.0, 7.0), e(-1.0, 1.0, 0.0)], [1.0, 1.0], standardize=False).collect()]
    assert got == [("a1", 1.0), ("a2", 1.0), ("a3", -2.0)]
    old = [(f"A{k:02d}", float(100 - k)) for k in range(1, 51)]
    new = [(i, {"A01": 60.0, "A40": 99.0}.get(i, v)) for i, v in old]
    frame = lambda rows: spark.createDataFrame(rows, "id string, ebv double")
    row = sl.rank_drift(frame(old), frame(new), 10).first()
    assert (row.n_common, row.retained) == (50, 9)
    assert {r.id: r.change for r in sl.rank_movers(frame(old), frame(new), 2).collect()} == {"A01": -39, "A40": 39}


def test_files(spark):
    from pyarrow import fs

    m = np.array([[2, 0, 1], [1, 0, 1], [0, 1, 1], [5, 1, 1], [2, 2, 1]])
    bed, bim, fam = write_plink(["i1", "i2", "i3", "i4", "i5"], ["m1", "m2", "m3"], m)
    assert bed[:4] == b"\x6c\x1b\x01" + bytes([0b01111000])
    prefix = shared_folder(spark, "bed") + "/x"
    store, path = fs.FileSystem.from_uri(prefix)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    for end, data in ((".bed", bed), (".bim", bim.encode()), (".fam", fam.encode())):
        with store.open_output_stream(path + end) as out:
            out.write(data)
    rows, marks = read_plink(spark, prefix)
    got = {(r.id, r.marker): r.dosage for r in rows.collect()}
    assert all(got[f"i{i + 1}", f"m{j + 1}"] == (None if m[i, j] == 5 else m[i, j]) for i in range(5) for j in range(3)) and marks.count() == 3
    with store.open_output_stream(path + ".bed") as out:
        out.write(bed[:-1])
    with pytest.raises(Exception):
        read_plink(spark, prefix)[0].collect()
    text = shared_folder(spark, "snp")
    spark.createDataFrame([("  a1 0125",), ("  a2 2210",)], "value string").write.text(text)
    assert sorted((r.id, r.marker, r.dosage) for r in read_snp_lines(spark, text).collect())[:4] == [("a1", "1", 0), ("a1", "2", 1), ("a1", "3", 2), ("a1", "4", None)]


def test_genotype_quality(spark):
    rng, rows = np.random.default_rng(7), []
    for i in range(120):
        for j in range(5):
            rows.append((str(i), f"g{j}", int(rng.binomial(2, 0.4))))
        rows += [(str(i), "lost", None if i % 5 == 0 else i % 3), (str(i), "rare", int(i == 3)), (str(i), "het", 1)]
    df = spark.createDataFrame(rows, "id string, marker string, dosage int")
    out = gt.qc_genotypes(df, hwe_limit=1e-4)
    assert {(n, r) for k, n, r, _ in out.removed if k == "marker"} >= {("lost", "call rate"), ("rare", "maf"), ("het", "hwe")}
    assert {r.marker for r in out.geno.select("marker").distinct().collect()} == {f"g{j}" for j in range(5)}
    with pytest.raises(ValueError):
        gt.check_values(df.selectExpr("id", "marker", "dosage + 2 as dosage"))


def _simulated(spark):
    rng = np.random.default_rng(2)
    n, m = 40, 120
    sire, dam = [0] * 10 + [1 + k % 5 for k in range(30)], [0] * 10 + [6 + k % 5 for k in range(30)]
    ped = pedigree(spark.createDataFrame([(str(k + 1), str(s), str(d)) for k, (s, d) in enumerate(zip(sire, dam, strict=True))], "id string, sire string, dam string"))
    p = rng.uniform(0.2, 0.8, m)
    hap = np.zeros((n, 2, m), int)
    for k in range(n):
        for side, parent in enumerate((sire[k], dam[k])):
            hap[k, side] = rng.random(m) < p if not parent else np.where(rng.random(m) < 0.5, hap[parent - 1, 0], hap[parent - 1, 1])
    geno = hap.sum(1)
    rows = [(str(k + 1), f"m{j:03d}", int(geno[k, j])) for k in range(5, n) for j in range(m)]
    return ped, spark.createDataFrame(rows, "id string, marker string, dosage int"), geno[5:]


def test_single_step_collapses(spark):
    ped, geno, m = _simulated(spark)
    fam = Family(ped)
    levels, h, prior, own = ss.h_inverse(fam, geno, weight=1.0)
    assert np.allclose(h, fam.inverse(), atol=1e-8)  # all weight on the pedigree
    p = m.mean(0) / 2
    z = (m - 2 * p)[:, (p > 0) & (p < 1)]
    g = z @ z.T / (2 * p * (1 - p)).sum()
    ids = [str(k) for k in range(6, 41)]
    got = {(r.i, r.j): r.x for r in gt.g_matrix(geno).collect()}
    assert all(got[max(a, b), min(a, b)] == pytest.approx(g[i, j]) for i, a in enumerate(ids) for j, b in enumerate(ids))
    assert np.allclose(ss.core_inverse(own.g + 0.01 * np.eye(35), list(range(35))), np.linalg.inv(own.g + 0.01 * np.eye(35)))
    part = ss.core_inverse(own.g, list(range(20)))
    assert np.allclose(np.linalg.inv(part)[:20, :20], own.g[:20, :20])
    gi, rows = ss.apy_blocks(geno, ids[:20])
    block = {r.id: (r.p, r.m) for r in rows.collect()}
    full = g + 0.01 * np.eye(35)
    order = sorted(range(20), key=lambda k: ids[k])
    assert block["30"][1] == pytest.approx(full[24, 24] - full[24][order] @ np.linalg.inv(full[np.ix_(order, order)]) @ full[order, 24])
    exact, lanczos = ss.apy_core(geno, 0.9, method="exact"), ss.apy_core(geno, 0.9, method="lanczos", probes=60)
    assert abs(exact.size - lanczos.size) <= 3
    records = spark.createDataFrame([(i, float(10 + z[k, :9].sum() + (k * 7 % 5))) for k, i in enumerate(ids)], "id string, y double")
    fit, effects = ss.snp_blup("y ~ animal(id)", records, ped, geno, {"var(animal)": 2.0, "var(residual)": 1.0}, 0.05)
    u = {r: v for r, v in zip(fit.design.groups[0].levels, fit.walk.evaluation.solution[fit.design.groups[0].columns(0)], strict=True)}
    assert np.corrcoef(z @ effects, [u[i] for i in ids])[0, 1] > 0.99
    gamma = ss.estimate_gamma(fam, dict.fromkeys(fam.ids, 0), geno, "gls")
    assert gamma.shape == (1, 1) and 0 <= gamma[0, 0] < 2
    out = ss.pegs(np.stack([z[:, :9].sum(1), z[:, :9].sum(1) * 0.5 + z[:, 20]], 1), z, most=50)
    assert np.corrcoef(z @ out["effects"][:, 0], z[:, :9].sum(1))[0, 1] > 0.9


def test_chains(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4, 1000))
    assert ch.rhat(x) < 1.01 and 3000 < ch.ess(x) < 5500 and abs(ch.geweke_z(x)) < 4
    assert ch.rhat(x + np.arange(4)[:, None]) > 1.2
    ar = np.zeros((2, 4000))
    for k in range(1, 4000):
        ar[:, k] = 0.9 * ar[:, k - 1] + rng.normal(size=2)
    assert ch.ess(ar) == pytest.approx(8000 * 0.1 / 1.9, rel=0.4)
    assert ch.heidelberger_welch(x[0])[0] and not ch.heidelberger_welch(np.linspace(0, 5, 500) + x[0, :500])[0]
    assert ch.multivariate_ess(np.stack([x[0], x[1]], 1)) > 400 and ch.multivariate_rhat(np.stack([x, x**2], 2)) < 1.02
    with pytest.raises(ValueError):
        ch.half_t(0)


def test_draws_have_the_exact_moments(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(f"g{k % 5}", float(rng.normal() + k % 5)) for k in range(60)], "g string, y double")
    draws = ch.gibbs("y ~ random(g)", df, n_iter=3000, burnin=100, thin=1, chains=2, theta={"var(g)": 2.0, "var(residual)": 1.0})
    from lodestock.operators.mixed import model

    fit = model("y ~ random(g)", df, start={"var(g)": 2.0, "var(residual)": 1.0}, most=0)
    sol, pev = fit.walk.evaluation.solution, np.diag(fit.walk.evaluation.inverse)
    got = {r.parameter: (r["avg(value)"], r["v"]) for r in draws.groupBy("parameter").agg(F.avg("value"), F.var_samp("value").alias("v")).collect()}
    for c in fit.likelihood.kept.tolist():
        assert got[f"b[{c}]"][0] == pytest.approx(sol[c], abs=5 * (pev[c] / 3000) ** 0.5) and got[f"b[{c}]"][1] == pytest.approx(pev[c], rel=0.2)
    rows = ch.diagnostics(ch.gibbs("y ~ random(g)", df, n_iter=1500, burnin=300, thin=2, chains=2, prior=ch.half_t())).collect()
    assert {r.parameter for r in rows} == {"var(g)", "var(residual)"} and all(r["mean"] > 0 for r in rows)
    y = (rng.random(150) < 0.4).astype(int)
    assert np.isfinite(ch.probit_gibbs(y, np.ones((150, 1)), rng.integers(0, 6, 150), 60, 20)).all()


def test_stream_sums(spark, tmp_path):
    spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 4.0), ("a", None)], "g string, y double").repartition(2).write.parquet(f"{tmp_path}/in")
    run = RunningMeans(spark, "g", "y")
    run.start(spark.readStream.schema("g string, y double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")).awaitTermination()
    assert {r.level: (r.n, r.sum) for r in run.table().collect()} == {"a": (2, 5.0), "b": (1, 2.0)}


def test_gamma_says_when_it_has_not_converged(spark):
    from lodestock.queries import _genotyped

    geno, ped, _ = _genotyped(spark, "/root/testdata/sf0.001")
    fam = Family(ped)
    group = {i: int(i) % 2 for i in fam.ids}
    full = ss.estimate_gamma(fam, group, geno, "em")
    with pytest.raises(ValueError, match="convergence"):
        ss.estimate_gamma(fam, group, geno, "em", most=2)
    assert np.abs(ss.estimate_gamma(fam, group, geno, "em", start=0.02) - full).max() < 1e-5


def small_genotypes(spark, animals=40, markers=12, seed=3):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(f"a{i}", f"m{j}", None if rng.random() < 0.05 else int(rng.integers(3))) for i in range(animals) for j in range(markers)], "id string, marker string, dosage int")


def test_affine_coefficients_need_no_pairs_of_animals(spark, monkeypatch):
    geno = small_genotypes(spark)
    a22 = geno.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("x")).distinct()
    for plain in (False, True):
        rows, scale = gt.centred(geno, plain)
        want = gt.affine_coefficients(gt.gram(rows, scale), a22).first()
        assert gt.affine_of(rows, scale, a22).first() == pytest.approx(want, abs=1e-10)
    monkeypatch.setattr(gt, "gram", lambda *a, **b: pytest.fail("pairs of animals"))
    assert not QUERIES["affine_coef"](spark, "/root/testdata/sf0.001").isEmpty()


def test_a_core_size_needs_no_animals_on_the_driver(spark, monkeypatch):
    geno = small_genotypes(spark)
    z = gt.dense(gt.centred(geno)[0])[1]
    values = np.linalg.eigvalsh(z.T @ z)[::-1]
    monkeypatch.setattr(ss, "dense", lambda rows: pytest.fail("all animals"))
    core = ss.apy_core(geno, 0.9)
    assert core.size == np.searchsorted(np.cumsum(values) / values.sum(), 0.9) + 1 and len(core.ids) == core.size


def test_marker_regression_from_sums_of_products(spark, monkeypatch):
    geno = small_genotypes(spark, 60)
    rows = gt.centred(geno)[0]
    ids, z = gt.dense(rows)
    rng = np.random.default_rng(1)
    y = z[:, :3].sum(1, keepdims=True) * [1.0, 0.5] + rng.normal(size=(60, 2))
    y[::5, 1] = np.nan
    sides = spark.createDataFrame([(i, [None if np.isnan(x) else float(x) for x in v]) for i, v in zip(ids, y, strict=True)], "id string, y array<double>")
    want, got = ss.pegs(y, z, most=60), ss.pegs_products(*gt.cross_products(rows, sides, 2)[1:], most=60)
    for name in want:
        assert np.allclose(got[name], want[name], atol=1e-9), name
    monkeypatch.setattr(gt, "dense", lambda rows: pytest.fail("all animals"))
    assert not QUERIES["pegs_effects"](spark, "/root/testdata/sf0.001").isEmpty()


def genotyped_family(spark, seed=4, n=60):
    """All animals genotyped: founders, one known parent, both, inbred, full sibs; some without records."""
    rng = np.random.default_rng(seed)
    rows = [(f"a{k}", f"a{rng.integers(k)}" if k > 8 and k % 5 else None, f"a{rng.integers(k)}" if k > 12 and k % 3 else None) for k in range(n)]
    rows += [("b1", "a0", "a1"), ("b2", "a0", "a1"), ("b3", "b1", "b2"), ("b4", "b1", "b1")]
    ped = spark.createDataFrame(rows, "id string, sire string, dam string")
    geno = spark.createDataFrame([(r[0], f"m{j}", None if rng.random() < 0.03 else int(rng.integers(3))) for r in rows for j in range(10)], "id string, marker string, dosage int")
    data = spark.createDataFrame([(rows[k][0], f"h{k % 3}", float(rng.normal()), float(rng.normal())) for k in rng.integers(0, n, 120)], "id string, h string, x double, y double")
    return ped, geno, data


@pytest.mark.parametrize("adjust", [True, False])
def test_genotyped_pedigrees_need_no_square_of_the_animals(spark, monkeypatch, adjust):
    ped, geno, data = genotyped_family(spark)
    fam = Family(ped)
    ids, want, prior, _ = ss.h_inverse(fam, geno, 0.1, adjust=adjust, least=0)
    start = {"var(animal)": 0.7, "var(residual)": 1.2}
    call = lambda: ss.single_step("y ~ h + cov(x) + animal(id)", data, ped, geno, 0.1, None, adjust, 0, start=start, most=0)
    dense_fit, dense_own = call()
    effects = ss.marker_effects(dense_fit, dense_own)
    monkeypatch.setattr(ss, "DENSE_ANIMALS", 10)
    monkeypatch.setattr(ss, "blended", lambda *a: pytest.fail("a square of the animals"))
    got = {(r.i, r.j): r.x for r in ss.h_inverse_table(spark, fam, geno, 0.1, adjust, 0, block=7).collect()}
    assert len(got) == len(ids) * (len(ids) + 1) // 2 and all(i >= j for i, j in got)
    place = {a: k for k, a in enumerate(ids)}
    assert all(x == pytest.approx(want[place[i], place[j]], abs=1e-8) for (i, j), x in got.items())
    fit, own = call()
    assert isinstance(own, ss.LowRank) and np.allclose(own.diagonal, prior)
    for name in ("ebv", "se", "acc"):
        assert {r.id: r[name] for r in mx.solutions(fit).collect()} == pytest.approx({r.id: r[name] for r in mx.solutions(dense_fit).collect()}, abs=1e-7)
    assert {r.effect: r.estimate for r in fit.coefficients().collect()} == pytest.approx({r.effect: r.estimate for r in dense_fit.coefficients().collect()}, abs=1e-8)
    assert np.allclose(ss.marker_effects(fit, own), effects, atol=1e-8)


def test_founder_groups_need_no_square_of_the_animals(spark, monkeypatch):
    ped, geno, _ = genotyped_family(spark)
    fam = Family(ped)
    group = {a: k % 2 for k, a in enumerate(fam.ids)}
    want = {m: ss.estimate_gamma(fam, group, geno, m, tolerance=1e-4) for m in ("gls", "em")}
    monkeypatch.setattr(ss, "DENSE_ANIMALS", 10)
    monkeypatch.setattr(ss, "_gamma_dense", lambda *a: pytest.fail("a square of the animals"))
    for m, gamma in want.items():
        assert np.allclose(ss.estimate_gamma(fam, group, geno, m, tolerance=1e-4), gamma, atol=1e-9), m
    with pytest.raises(ValueError, match="convergence"):
        ss.estimate_gamma(fam, group, geno, "em", most=2)
