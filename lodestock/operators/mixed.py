"""Fitting mixed models, and reading the fit."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestock.functions.labels import canonical_label, is_unknown_animal
from lodestock.operators.checks import check_model
from lodestock.operators.likelihood import Likelihood, Walk, likelihood, maximize
from lodestock.operators.linear import BORDER_ROWS, DRIVER_ENTRIES, bordered_solve, conjugate_gradients
from lodestock.operators.pedigree import Family, a_inverse, pruned, with_founders
from lodestock.plans.design import DRIVER_CELLS, DRIVER_COLUMNS, Cells, Design, Group, build, cells_of, independent, laid_out, level_statistics, statistics, triplets
from lodestock.plans.formula import FIXED, RELATIONSHIP, Formula, parse
from lodestock.session import written

__all__ = ["Fit", "LargeFit", "build", "fitted", "h2", "h2_curve", "model", "phenotypic_variance", "profile", "residuals", "rg", "se_function", "solutions", "summary", "statistics", "variance_table"]


@dataclass
class Fit:
    """theta by name, its standard errors, and what the extractors need. Small things live on the driver; tables are DataFrames."""

    spark: SparkSession
    design: Design
    likelihood: Likelihood
    walk: Walk
    prior: dict[str, float]
    family: Family | None

    @property
    def theta(self) -> dict[str, float]:
        return dict(zip(self.likelihood.names, self.walk.evaluation.theta.tolist(), strict=True))

    @property
    def neg2logl(self) -> float:
        return self.walk.evaluation.neg2logl

    @property
    def converged(self) -> bool:
        return self.walk.converged

    @property
    def vcov(self) -> np.ndarray:
        return 2 * np.linalg.pinv(self.walk.evaluation.information)

    @property
    def se(self) -> dict[str, float]:
        return dict(zip(self.likelihood.names, np.sqrt(np.maximum(np.diag(self.vcov), 0)).tolist(), strict=True))

    @property
    def singular(self) -> list[str]:
        """Components that the information cannot tell apart."""
        info = self.walk.evaluation.information
        scale = np.sqrt(np.maximum(np.diag(info), 1e-300))
        values, vectors = np.linalg.eigh(info / np.outer(scale, scale))
        bad = vectors[:, values < 1e-8 * max(values.max(), 1e-300)]
        return [n for n, row in zip(self.likelihood.names, bad, strict=True) if (np.abs(row) >= 0.2).any()]

    def coefficients(self) -> DataFrame:
        """(trait, effect, estimate) of the fixed part; columns that depend on earlier ones are left out."""
        width, rows = self.design.width, []
        kept = set(self.likelihood.kept.tolist())
        for k, trait in enumerate(self.design.formula.traits):
            rows += [(trait, n, float(self.walk.evaluation.solution[k * width + c])) for c, n in enumerate(self.design.fixed) if k * width + c in kept]
        return self.spark.createDataFrame(rows, "trait string, effect string, estimate double")

    def components(self) -> DataFrame:
        return self.spark.createDataFrame([(n, v, self.se[n]) for n, v in self.theta.items()], "component string, estimate double, se double")


@dataclass
class LargeFit:
    """What is solved at given components as tables: theta, the solutions by name of the column, and of conjugate gradients the iterations and the relative residual (both 0 where blocks are solved one by one). No errors: they need the inverse."""

    spark: SparkSession
    formula: Formula
    theta: dict[str, float]
    table: DataFrame
    names: list[tuple[str, str]]
    iterations: int
    left: float
    converged: bool = False

    def coefficients(self) -> DataFrame:
        """(trait, effect, estimate) of the fixed part; columns that depend on earlier ones are left out."""
        return self.table.filter(F.col("i").startswith("b|")).select(F.lit(self.formula.traits[0]).alias("trait"), F.substring("i", 3, 1 << 30).alias("effect"), F.col("x").alias("estimate"))


def _pedigree_of(cells: Cells, pedigree: DataFrame | None) -> DataFrame | None:
    """The pedigree cut to animals with records and their ancestors, founders added for those without a line."""
    own = sorted({e.key for e in cells.entries if e.key is not None and e.prefix.split("|")[0] in cells.related})
    if not own:
        return None
    if pedigree is None:
        raise ValueError("a relationship term needs a pedigree")
    ids = written(cells.every.select(F.explode(F.array(*[F.col(f"key_{k}") for k in own])).alias("id")).filter("id is not null").distinct(), "ids")
    return written(pruned(with_founders(pedigree, ids), ids), "pedigree")


def relationship_levels(df: DataFrame, formula: Formula, pedigree: DataFrame | None) -> Family | None:
    """The same of records, as arrays."""
    columns = {c for t in formula.terms if t.kind == RELATIONSHIP for c in (t.column, t.mgs) if c}
    if not columns:
        return None
    if pedigree is None:
        raise ValueError("a relationship term needs a pedigree")
    ids = df.select(F.explode(F.array(*[canonical_label(df, c) for c in sorted(columns)])).alias("id")).filter(~is_unknown_animal(F.col("id"))).distinct()
    return Family(pruned(with_founders(pedigree, ids), ids))


def model(formula: str, df: DataFrame, pedigree: DataFrame | None = None, start: dict[str, float] | None = None, most: int = 300, tolerance: float = 1e-8, warm: int = 4, weights: str | None = None, missing_code: float | None = None, kinverse: tuple[list[str], np.ndarray, np.ndarray] | None = None, residual_by: str | None = None, checks: bool = True) -> Fit | LargeFit:
    """Fit one or more traits by AI-REML, or solve at the given components (most = 0, start given).

    residual_by: a column whose levels have a residual variance each, var(residual|level). kinverse: (levels,
    inverse relationship, diagonal of the relationship) to use instead of a pedigree's, as single-step does.
    checks: what operators.checks.check_model refuses or warns of.
    The levels of the largest group that is independent by level are eliminated one by one, and do not count as
    columns. With over DRIVER_COLUMNS other levels and most = 0 the equations of one trait stay a table of triplets, which
    conjugate gradients solve: the result is a LargeFit.
    """
    f = parse(formula)
    cells = cells_of(df, f, weights, missing_code, residual_by)
    if checks:
        check_model(cells, f, most > 0)
    ped = None if kinverse else _pedigree_of(cells, pedigree)
    related = ped.count() if ped is not None else len(kinverse[0]) if kinverse else 0
    apart = cells.apart(f, DRIVER_COLUMNS - related, related)
    size = max(cells.n_levels(DRIVER_COLUMNS), related)
    if size > DRIVER_COLUMNS and most == 0 and not kinverse and apart is None:
        return solved_large(cells, f, ped, start or {}, tolerance)
    fam = Family(ped) if ped is not None else None
    levels = kinverse[0] if kinverse else fam.ids if fam else None
    design = laid_out(cells, f, levels)
    patterns = statistics(design) if apart is None else level_statistics(design, apart)
    if not patterns:
        raise ValueError("no record has an observed trait")
    related = kinverse[1] if kinverse else fam.inverse() if fam else None
    lik = likelihood(design, [related if g.relationship else None for g in design.groups])
    n = sum(s.n * sum(m[: lik.traits]) for m, s in patterns.items())
    if most > 0 and n <= lik.rank:
        raise ValueError(f"{n} observations and {lik.rank} fixed columns leave nothing to estimate variances from")
    first = None
    if start is not None:
        if unknown := set(start) - set(lik.names):
            raise ValueError(f"no components {sorted(unknown)}; there are {lik.names}")
        first = np.array([start.get(n, 0.0) for n in lik.names])
    walk = maximize(lik, first, most, tolerance, warm)
    diagonal = dict(zip(levels, (kinverse[2] if kinverse else 1 + fam.f).tolist(), strict=True)) if levels else {}
    return Fit(df.sparkSession, design, lik, walk, diagonal, fam)


def solved_large(cells: Cells, formula: Formula, ped: DataFrame | None, start: dict[str, float], tolerance: float = 1e-10) -> LargeFit:
    """The mixed model equations of one trait at given components as triplets, solved by conjugate gradients; many equations that only a few fixed columns connect (families) are solved block by block.

    Rows and columns are named as the cells name them. Fixed columns that depend on earlier ones are left
    out, as in a small model; their cross products are all that the driver holds.
    """
    if len(formula.traits) != 1:
        raise ValueError("one trait at a time in a model of this size")
    groups = list(formula.groups.items())
    residual = {c: start[f"var(residual|{c}" + ")"] for c in cells.classes} if cells.classes else {"": start["var(residual)"]}
    spread = F.create_map(*[F.lit(v) for pair in residual.items() for v in pair])[F.col("class")]
    products, sides = triplets(cells)
    scaled = lambda df, *by: df.groupBy(*by).agg(F.sum(F.col("x") / spread).alias("x"))
    products, sides = written(scaled(products, "i", "j"), "products"), scaled(sides, "i")
    xx = products.filter(F.col("i").startswith("b|") & F.col("j").startswith("b|")).limit(DRIVER_CELLS).toArrow()
    order = cells.fixed_order(formula)
    place = {n: k for k, n in enumerate(order)}
    dense = np.zeros((len(order), len(order)))
    for i, j, x in zip(xx["i"].to_pylist(), xx["j"].to_pylist(), xx["x"].to_pylist(), strict=True):
        dense[place[i], place[j]] = dense[place[j], place[i]] = x
    lost = [n for n, keep in zip(order, independent(dense), strict=True) if not keep]
    if lost:
        out = F.broadcast(cells.table.sparkSession.createDataFrame([(n,) for n in lost], "n string"))  # fixed columns, which the driver has held
        products = products.join(out.withColumnRenamed("n", "i"), "i", "left_anti").join(out.withColumnRenamed("n", "j"), "j", "left_anti").select("i", "j", "x")
        sides = sides.join(out.withColumnRenamed("n", "i"), "i", "left_anti")
    parts, names = [products], []
    inverse = written(a_inverse(ped), "a-inverse") if ped is not None else None
    for g, (name, terms) in enumerate(groups):
        coefficients = [f"{t.name}[{k}]" if t.base else t.name for t in terms for k in range(t.coefficients)]
        names += [(f"u{g}.{a}|", c) for a, c in enumerate(coefficients)]
        cov = np.array([[start.get(f"var({x})" if a == b else f"cov({coefficients[max(a, b)]},{coefficients[min(a, b)]})", 0.0) for b, _ in enumerate(coefficients)] for a, x in enumerate(coefficients)])
        precision = np.linalg.inv(cov)
        if terms[0].kind == RELATIONSHIP:
            own = inverse
        else:
            keys = sorted({e.key for e in cells.entries if e.prefix.startswith(f"u{g}.")})
            level = cells.every.select(F.explode(F.array(*[F.col(f"key_{k}") for k in keys])).alias("i")).filter("i is not null").distinct()
            own = level.select("i", F.col("i").alias("j"), F.lit(1.0).alias("x"))
        for a in range(len(coefficients)):
            for b in range(a + 1):
                both = own if a == b else own.unionByName(own.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "x"))
                i, j = F.concat(F.lit(f"u{g}.{a}|"), "i"), F.concat(F.lit(f"u{g}.{b}|"), "j")
                parts.append(both.select(F.greatest(i, j).alias("i"), F.least(i, j).alias("j"), (F.col("x") * float(precision[a, b])).alias("x")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = written(every.groupBy("i", "j").agg(F.sum("x").alias("x")), "equations")
    sides = written(sides.withColumnRenamed("x", "b"), "sides")
    border = [n for n in order if n not in set(lost)]
    if len(border) <= BORDER_ROWS and every.count() > DRIVER_ENTRIES and (table := bordered_solve(every, sides, border)) is not None:
        return LargeFit(cells.table.sparkSession, formula, dict(start), written(table, "solutions"), names, 0, 0.0)
    table, iterations, left = conjugate_gradients(every, sides, tolerance)
    return LargeFit(cells.table.sparkSession, formula, dict(start), written(table, "solutions"), names, iterations, left)


def _group(fit: Fit, name: str | None) -> tuple[int, Group]:
    groups = fit.design.groups
    if name is None:
        own = [g for g in groups if g.relationship and "maternal" not in g.name] or [g for g in groups if g.relationship] or groups
        name = own[0].name
    for k, g in enumerate(groups):
        if g.name == name:
            return k, g
    raise ValueError(f"no group {name}")


def solutions(fit: Fit | LargeFit, group: str | None = None, trait: str | None = None) -> DataFrame:
    """(id, term, ebv, se, acc), best first: se is the root of the prediction error variance, acc the root of 1 - PEV / (k var), with k the level's own relationship. se and acc of a large fit are null, unless its table has the prediction error variance and the prior one (pev, prior)."""
    if isinstance(fit, LargeFit):
        groups = list(fit.formula.groups)
        own = [g for g, terms in fit.formula.groups.items() if terms[0].kind == RELATIONSHIP and "maternal" not in g] or groups
        g = groups.index(group or own[0])
        named = [F.struct(F.lit(p).alias("p"), F.lit(n).alias("term")) for p, n in fit.names if p.startswith(f"u{g}.")]
        rows = fit.table.select("x", *[c for c in ("pev", "prior") if c in fit.table.columns], F.substring_index("i", "|", 1).alias("p"), F.expr("substring(i, instr(i, '|') + 1)").alias("id"))
        rows = rows.join(F.broadcast(fit.spark.range(1).select(F.inline(F.array(*named))).withColumn("p", F.expr("substring(p, 1, length(p) - 1)"))), "p")  # a row a coefficient
        none = F.lit(None).cast("double")
        se, acc = (F.sqrt(F.greatest("pev", F.lit(0.0))), F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("pev") / F.col("prior")))) if "pev" in fit.table.columns else (none, none)
        return rows.select("id", "term", F.col("x").alias("ebv"), se.alias("se"), acc.alias("acc")).orderBy(F.desc("ebv"), "id")
    g, own = _group(fit, group)
    traits, lik = fit.design.formula.traits, fit.likelihood
    k = traits.index(trait) if trait else lik.pairs[g][0][0]
    cov = lik.matrices(fit.walk.evaluation.theta)[g]
    pev_of = fit.walk.evaluation.inverse.diagonal()
    parts = []
    for a, (t, c) in enumerate(lik.pairs[g]):
        if t != k:
            continue
        at = lik._columns(g, a)
        u, pev = fit.walk.evaluation.solution[at], pev_of[at]
        prior = np.array([fit.prior.get(x, 1.0) if own.relationship else 1.0 for x in own.levels])
        acc = np.sqrt(np.maximum(0.0, 1 - pev / (prior * cov[a, a])))
        parts.append(pa.table({"id": pa.array(own.levels, pa.string()), "term": pa.array([own.names[c]] * own.n, pa.string()), "ebv": u, "se": np.sqrt(np.maximum(pev, 0)), "acc": acc}))
    if not parts:
        raise ValueError(f"{own.name} is not in {traits[k]}")
    return fit.spark.createDataFrame(pa.concat_tables(parts)).orderBy(F.desc("ebv"), "id")


def harmonic_weight(fit: Fit) -> float:
    """The harmonic mean of the records' weights: the weight whose residual variance is the mean one."""
    n, inverse = fit.design.cells.table.agg(F.sum("n"), F.sum("inverse")).first()
    return n / inverse


def phenotypic_variance(fit: Fit, trait: str | None = None, weight: float | None = None) -> float:
    """Sum of the variances and of the covariances within groups, of one trait; the residual one at a weight, by default the harmonic mean of the records'."""
    k = fit.design.formula.traits.index(trait) if trait else 0
    lik, theta = fit.likelihood, fit.walk.evaluation.theta
    total = lik.residual(theta)[k, k] / (weight or harmonic_weight(fit))
    for pairs, c in zip(lik.pairs, lik.split(theta)[0], strict=True):
        own = [a for a, (j, _) in enumerate(pairs) if j == k]
        total += np.tril(c[np.ix_(own, own)]).sum()
    return float(total)


def h2(fit: Fit, group: str | None = None, trait: str | None = None, weight: float | None = None) -> float:
    """Share of the phenotypic variance; four times the sire variance in a sire model. Not a number if the data cannot tell the component apart."""
    g, own = _group(fit, group)
    if any(t.base for t in fit.design.formula.groups[own.name]):
        raise ValueError("a reaction norm has a heritability by point: see h2_curve")
    k = fit.design.formula.traits.index(trait) if trait else fit.likelihood.pairs[g][0][0]
    a = _first(fit, g, k)
    cov = fit.likelihood.matrices(fit.walk.evaluation.theta)[g]
    name = next(p.name for p in fit.likelihood.parameters if p.group == g and p.a == p.b == a)
    if name in fit.singular:
        return math.nan
    return float(cov[a, a]) * (4 if own.names[0] == "sire" else 1) / phenotypic_variance(fit, trait, weight)


def _first(fit: Fit, group: int, trait: int) -> int:
    """The place of a trait's first coefficient in a group's matrix."""
    for a, (k, _) in enumerate(fit.likelihood.pairs[group]):
        if k == trait:
            return a
    raise ValueError(f"{fit.design.groups[group].name} is not in {fit.design.formula.traits[trait]}")


def rg(fit: Fit, first: str, second: str, group: str | None = None) -> float:
    """Correlation of a group's effects between two traits."""
    g, _ = _group(fit, group)
    c = fit.likelihood.matrices(fit.walk.evaluation.theta)[g]
    a, b = (_first(fit, g, fit.design.formula.traits.index(t)) for t in (first, second))
    return float(c[a, b] / math.sqrt(c[a, a] * c[b, b]))


def variance_table(fit: Fit, trait: str | None = None) -> DataFrame:
    """(component, estimate, se, share, correlation): share of the phenotypic variance of the trait a component is of (covariances between traits: null), correlation of covariances."""
    lik, theta = fit.likelihood, fit.walk.evaluation.theta
    every, traits = lik.matrices(theta), fit.design.formula.traits
    k = traits.index(trait) if trait else 0
    total, rows = phenotypic_variance(fit, trait), []
    for p, v in zip(lik.parameters, theta.tolist(), strict=True):
        m = every[lik._place(p)]
        pairs = lik.pairs[p.group] if p.group is not None else [(t, 0) for t in range(lik.traits)]
        weight = 1.0 if p.group is not None else float(lik.counts[p.block] / lik.counts.sum())
        share = v * weight / total if pairs[p.a][0] == pairs[p.b][0] == k else None
        scale = math.sqrt(max(m[p.a, p.a] * m[p.b, p.b], 0.0))
        rows.append((p.name, v, fit.se[p.name], share, v / scale if p.a != p.b and scale > 0 else None))
    return fit.spark.createDataFrame(rows, "component string, estimate double, se double, share double, correlation double")


def h2_curve(spark: SparkSession, covariances: dict[str, np.ndarray], residual: float, group: str, low: float, high: float, points: int = 101, plain: float = 0.0) -> DataFrame:
    """(x, genetic, phenotypic, h2) at points between the limits: phi' C phi of each group over Legendre polynomials of its order."""
    from lodestock.functions.basis import legendre

    x = F.lit(low) + F.col("id") * ((high - low) / (points - 1))
    out = spark.range(points).select("id", x.alias("x"))
    total = F.lit(residual + plain)
    for name, c in covariances.items():
        phi = legendre(F.col("x"), len(c) - 1, low, high)
        form = F.lit(0.0)
        for a in range(len(c)):
            for b in range(len(c)):
                form = form + phi[a] * phi[b] * float(c[a, b])
        out = out.withColumn(f"_{name}", form)
        total = total + F.col(f"_{name}")
    return out.select("x", F.col(f"_{group}").alias("genetic"), total.alias("phenotypic"), (F.col(f"_{group}") / total).alias("h2")).orderBy("x")


def fitted(fit: Fit, df: DataFrame, trait: str | None = None) -> DataFrame:
    """df with fitted (fixed and random), fitted_fixed, residual (conditional) and residual_marginal: solutions joined to the records by level.

    One join a term with a table of its levels; records stay where they are as long as Spark finds the tables small.
    """
    f = fit.design.formula
    k = f.traits.index(trait) if trait else 0
    sol = fit.walk.evaluation.solution[k * fit.design.width : (k + 1) * fit.design.width]
    fixed = dict(zip(fit.design.fixed, sol[: fit.design.p].tolist(), strict=True))
    rows, mean, random = df, F.lit(fixed["(Intercept)"]), F.lit(0.0)
    n = 0

    def attach(column: str, values: dict[str, float]):
        nonlocal rows, n
        n += 1
        table = fit.spark.createDataFrame(pa.table({f"_l{n}": pa.array(list(values), pa.string()), f"_v{n}": pa.array(list(values.values()), pa.float64())}))
        rows = rows.join(table, canonical_label(df, column) == F.col(f"_l{n}"), "left")
        return F.coalesce(f"_v{n}", F.lit(0.0))

    own = lambda t: not t.traits or f.traits[k] in t.traits
    for t in filter(own, f.fixed):
        by = t.column if t.kind == FIXED else t.nested
        if by:
            head = f"{t.column}{'|' + by if t.nested else ''}="
            value = attach(by, {x[len(head) :]: v for x, v in fixed.items() if x.startswith(head)})
            mean = mean + (value if t.kind == FIXED else value * F.col(t.column))
        else:
            mean = mean + F.col(t.column) * fixed[t.column]
    for group in fit.design.groups:
        at = 0
        for t in f.groups[group.name]:
            for j in range(t.coefficients if own(t) else 0):
                u = dict(zip(group.levels, sol[group.columns(at + j)].tolist(), strict=True))
                for column, share in ((t.column, 1.0), (t.mgs, 0.5)):
                    if column:
                        random = random + attach(column, u) * share * (F.col(t.base[j]) if t.base else F.lit(1.0))
            at += t.coefficients
    y = F.col(f.traits[k]).cast("double")
    out = rows.withColumn("fitted_fixed", mean).withColumn("fitted", F.col("fitted_fixed") + random)
    return out.select(*df.columns, "fitted", "fitted_fixed", (y - F.col("fitted")).alias("residual"), (y - F.col("fitted_fixed")).alias("residual_marginal"))


def leverages(fit: Fit) -> DataFrame:
    """One row a cell of the records (key_k: its labels): h_a_b, the coefficients of products of covariates a and b in the leverage of a record, before weight and residual variance."""
    design, cells = fit.design, fit.design.cells
    keys = [f"key_{k}" for k in range(cells.n_keys)]
    rows = cells.table.select(*keys).distinct().limit(DRIVER_CELLS + 1).toArrow() if keys else pa.table({"_one": [0]})
    if rows.num_rows > DRIVER_CELLS:
        raise ValueError(f"over {DRIVER_CELLS} cells of records")
    index, inverse, n = design.index(), fit.walk.evaluation.inverse, rows.num_rows
    places = []
    for e in cells.entries:
        labels = [e.prefix] * n if e.key is None else [None if x is None else e.prefix + x for x in rows[f"key_{e.key}"].to_pylist()]
        places.append(np.array([index.get(x, -1) for x in labels], np.int64))
    found = {(a, b): np.zeros(n) for a in range(cells.n_values) for b in range(a + 1)}
    for e, i in zip(cells.entries, places, strict=True):
        for f, j in zip(cells.entries, places, strict=True):
            found[max(e.value, f.value), min(e.value, f.value)] += np.where((i >= 0) & (j >= 0), inverse[i, j] * e.share * f.share, 0.0)
    return fit.spark.createDataFrame(pa.table({k: rows[k].cast(pa.string()) for k in keys} | {f"h_{a}_{b}": v for (a, b), v in found.items()}))


def residuals(fit: Fit, df: DataFrame, weights: str | None = None, residual_by: str | None = None, least: float = 1e-8) -> DataFrame:
    """fitted(), and leverage, pearson (over the residual deviation) and standardized (over its own deviation; null where 1 - leverage is under `least`) of a fit of one trait.

    weights and residual_by as the model had them. One join of the records with a table of their cells.
    """
    f, cells = fit.design.formula, fit.design.cells
    if len(f.traits) != 1 or bool(cells.classes) != bool(residual_by):
        raise ValueError("of a fit of one trait, with the residual classes that it had")
    out = fitted(fit, df)
    related = {c for t in f.terms if t.kind == RELATIONSHIP for c in (t.column, t.mgs) if c}
    cell = leverages(fit)
    label = lambda c, unknown: F.when(~is_unknown_animal(canonical_label(df, c)), canonical_label(df, c)) if unknown else canonical_label(df, c)
    on = [label(c, u).eqNullSafe(F.col(f"key_{k}")) for k, (c, u) in enumerate(cells.keys)]
    out = out.join(cell, on, "left") if on else out.crossJoin(F.broadcast(cell))  # one row
    v = [F.lit(1.0), *(F.col(c).cast("double") for c in cells.values)]
    h = sum((F.col(f"h_{a}_{b}") * v[a] * v[b] for a in range(len(v)) for b in range(a + 1)), F.lit(0.0))
    theta, w = fit.theta, F.col(weights).cast("double") if weights else F.lit(1.0)
    spread = F.create_map(*[x for c in cells.classes for x in (F.lit(c), F.lit(theta[f"var(residual|{c})"]))])[canonical_label(df, residual_by)] if residual_by else F.lit(theta["var(residual)"])
    out = out.withColumn("leverage", F.when(F.col("residual").isNotNull(), h * w / spread))
    pearson = F.col("residual") * F.sqrt(w) / F.sqrt(spread)
    free = 1 - F.col("leverage")
    out = out.withColumns({"pearson": pearson, "standardized": F.when(free >= least, pearson / F.sqrt(free))})
    return out.select(*df.columns, "fitted", "fitted_fixed", "residual", "residual_marginal", "leverage", "pearson", "standardized")


def summary(fit: Fit) -> str:
    """A fit in text: whether it converged, -2 log L, records, and the components with their errors and shares."""
    rows = variance_table(fit).collect()
    wide = max(len(r.component) for r in rows)
    number = lambda v: "" if v is None else f"{v:.5g}"
    head = f"{'converged' if fit.converged else 'not converged'} after {fit.walk.iterations} steps; -2 log L {fit.neg2logl:.5f}; {int(fit.likelihood.counts.sum())} records"
    lines = [f"{r.component:<{wide}}  {number(r.estimate):>12}  {number(r.se):>12}  {number(r.share):>8}" for r in rows]
    return "\n".join([head, f"{'component':<{wide}}  {'estimate':>12}  {'se':>12}  {'share':>8}", *lines])


def se_function(fit: Fit, f: Callable[[dict[str, float]], float], step: float = 1e-6) -> tuple[float, float]:
    """(value, standard error) of a function of the components, by the delta method with central differences."""
    theta = fit.walk.evaluation.theta
    at = lambda x: f(dict(zip(fit.likelihood.names, x.tolist(), strict=True)))
    slope = np.zeros(len(theta))
    for k in range(len(theta)):
        h = step * max(abs(theta[k]), 1e-8)
        up, down = theta.copy(), theta.copy()
        up[k], down[k] = up[k] + h, down[k] - h
        slope[k] = (at(up) - at(down)) / (2 * h)
    return at(theta), float(math.sqrt(max(0.0, slope @ fit.vcov @ slope)))


def profile(fit: Fit, component: str, grid: list[float], most: int = 200) -> list[tuple[float, float]]:
    """(value, -2 log L) with the component fixed at each value and the others at their best, each start the one before; outwards from the estimate."""
    lik = fit.likelihood
    k = lik.names.index(component)
    free = [i for i in range(len(lik.names)) if i != k]
    best: dict[float, float] = {}
    centre = fit.walk.evaluation.theta[k]
    for side in (sorted(v for v in grid if v >= centre), sorted((v for v in grid if v < centre), reverse=True)):
        theta = fit.walk.evaluation.theta.copy()
        for v in side:
            theta[k] = v
            if not lik.valid(theta, 0.0):
                continue
            for _ in range(most):
                now = lik.evaluate(theta)
                step = np.zeros(len(theta))
                if free:
                    step[free] = -np.linalg.lstsq(now.information[np.ix_(free, free)], now.score[free], rcond=None)[0]
                part = 1.0
                while part > 1e-6 and not (lik.valid(theta + part * step) and lik.value(theta + part * step) <= now.neg2logl + 1e-10):
                    part /= 2
                if part <= 1e-6 or np.abs(part * step).max() < 1e-10 * np.abs(theta).max():
                    break
                theta = theta + part * step
            best[v] = lik.value(theta)
    return sorted(best.items())
