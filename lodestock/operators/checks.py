"""What a fit checks before it runs, from the cells of its records: errors where the data cannot carry the model, warnings where they barely do."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestock.operators.genotypes import animal_stats, check_values, duplicates, marker_stats, parentage_check
from lodestock.plans.design import Cells
from lodestock.plans.formula import FIXED, IID, RELATIONSHIP, Formula, Term


def _warn(text: str) -> None:
    warnings.warn(text, UserWarning, stacklevel=4)


def check_traits(cells: Cells, formula: Formula) -> None:
    """A trait without variance, and two traits that are one (over three common records or more), are errors."""
    n = cells.traits
    row = cells.table.agg(*[f(f"{s}_{t}").alias(f"{s}_{t}") for t in range(n) for s, f in (("lo", F.min), ("hi", F.max))]).first()
    for t, name in enumerate(formula.traits):
        if row[f"lo_{t}"] is None or row[f"lo_{t}"] == row[f"hi_{t}"]:
            raise ValueError(f"{name} has no variance")
    for a in range(n):
        for b in range(a):
            both = cells.table.filter((F.substring("mask", a + 1, 1) == "1") & (F.substring("mask", b + 1, 1) == "1"))
            r = both.agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in ("s_0_0", f"t_0_{a}", f"t_0_{b}", f"y_{a}_{a}", f"y_{b}_{b}", f"y_{a}_{b}")]).first()
            if (r.n or 0) >= 3:
                spread = lambda x, y, xy: r[xy] - r[x] * r[y] / r["s_0_0"]  # noqa: B023, E731
                x, y, xy = spread(f"t_0_{a}", f"t_0_{a}", f"y_{a}_{a}"), spread(f"t_0_{b}", f"t_0_{b}", f"y_{b}_{b}"), spread(f"t_0_{a}", f"t_0_{b}", f"y_{a}_{b}")
                if x > 0 and y > 0 and abs(xy) / (x * y) ** 0.5 > 1 - 1e-10:
                    raise ValueError(f"{formula.traits[b]} and {formula.traits[a]} are collinear")


def check_bases(cells: Cells, formula: Formula, estimating: bool) -> None:
    """The columns of a basis must be independent, and should be of one scale."""
    place = {c: 1 + k for k, c in enumerate(cells.values)}
    terms = [t for t in formula.terms if t.base]
    if not terms:
        return
    names = [f"s_{a}_{b}" for a in range(cells.n_values) for b in range(a + 1)]
    row = cells.table.agg(*[F.sum(c).alias(c) for c in names]).first()
    for t in terms:
        at = [place[c] for c in t.base]
        gram = np.array([[row[f"s_{max(a, b)}_{min(a, b)}"] or 0.0 for b in at] for a in at])
        scale = np.sqrt(np.maximum(np.diag(gram), 0.0))
        if estimating and ((scale == 0).any() or np.linalg.eigvalsh(gram / np.outer(scale, scale))[0] < 1e-10):
            raise ValueError(f"the base of {t.name} has columns that depend on each other: {t.base}")
        if estimating and scale.max() / scale.min() > 100:
            _warn(f"the columns of the base of {t.name} differ in scale by {scale.max() / scale.min():.3g}: scale them alike")


def _key(cells: Cells, column: str) -> str:
    return f"key_{next(k for k, (c, _) in enumerate(cells.keys) if c == column)}"


def check_levels(cells: Cells, formula: Formula, estimating: bool) -> None:
    """A random term that has one level, or that a fixed class determines, has no variance that data tell: an error if it is estimated, else a warning. Few levels, and repeated records without a permanent effect, are warnings."""
    fixed = [t for t in formula.fixed if t.kind == FIXED]
    plain = [t for t in formula.terms if t.kind in (IID, RELATIONSHIP) and not t.base]

    def refuse(text: str) -> None:
        if estimating:
            raise ValueError(text)
        _warn(text)

    for t in plain:
        label = F.concat_ws("/", *[F.coalesce(F.col(_key(cells, c)), F.lit("0")) for c in (t.column, t.mgs) if c])
        known = F.col(_key(cells, t.column)).isNotNull() | (F.col(_key(cells, t.mgs)).isNotNull() if t.mgs else F.lit(False))
        row = cells.table.agg(F.min(F.when(known, label)).alias("low"), F.max(F.when(known, label)).alias("high"), F.count_if(~known).alias("unknown"), F.count_distinct(F.when(known, label)).alias("n")).first()
        if row.low is None:
            refuse(f"{t.name} has no known level")
        elif row.low == row.high and not row.unknown:
            refuse(f"{t.name} has a single level, which the intercept absorbs")
        elif t.kind == IID and row.n < 5:
            _warn(f"{t.name} has {row.n} levels: its variance is barely determined")
        for f in fixed:
            per = cells.table.groupBy(_key(cells, f.column)).agg(F.min(F.when(known, label)).alias("a"), F.max(F.when(known, label)).alias("b"), F.count_if(~known).alias("u"))
            r = per.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("a") == F.col("b")) & ((F.col("u") == 0))).alias("one"), F.count_if(F.col("a").isNull()).alias("none")).first()
            if r.n > 1 and r.one and r.one + r.none == r.n:
                refuse(f"{t.name} is nested in the fixed class {f.column}, which absorbs it")
    for t in plain:
        if t.kind == RELATIONSHIP and t.name == "animal" and not any(_covers(x, t) for x in formula.terms):
            r = cells.table.filter(F.col(_key(cells, t.column)).isNotNull()).groupBy(_key(cells, t.column)).agg(F.sum("n").alias("n")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n") > 1).alias("again")).first()
            if r.again:
                _warn(f"{r.again} of {r.n} animals have more than one record and there is no pe({t.column}): what lasts goes into var({t.name})")


def _covers(x: Term, animal: Term) -> bool:
    return x.kind == IID and x.column == animal.column and (not x.traits or set(animal.traits or x.traits) <= set(x.traits))


def check_model(cells: Cells, formula: Formula, estimating: bool) -> None:
    check_traits(cells, formula)
    check_bases(cells, formula, estimating)
    check_levels(cells, formula, estimating)


def check_genotypes(geno: DataFrame, pedigree: DataFrame | None = None, least: float = 0.9, exclusion: float = 0.01) -> None:
    """Codes other than 0, 1, 2 and null, repeated (animal, marker) cells, and animals with a call rate under `least` over the markers that vary (0: any) are errors; equal genotypes, and parents that genotypes rule out, are warnings."""
    check_values(geno)
    if twice := geno.groupBy("id", "marker").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(3).collect():
        raise ValueError(f"animals with two genotypes at a marker: {sorted({r.id for r in twice})}")
    if least > 0:
        varying = marker_stats(geno).filter("(n0 > 0 and n1 > 0) or (n0 > 0 and n2 > 0) or (n1 > 0 and n2 > 0)").select("marker")
        if low := animal_stats(geno.join(varying, "marker", "left_semi")).filter(F.col("call_rate") < least).orderBy("call_rate", "id").limit(3).collect():
            raise ValueError(f"animals with a call rate under {least}: {[(r.id, round(r.call_rate, 3)) for r in low]}")
    if same := duplicates(geno).orderBy("first").limit(3).collect():
        _warn(f"animals with the same genotype at all markers: {[(r['first'], r.n) for r in same]}")
    if pedigree is not None and exclusion > 0:
        if wrong := parentage_check(pedigree, geno, exclusion).filter("conflict").orderBy("id").limit(3).collect():
            _warn(f"parents that genotypes rule out: {[(r.id, r.parent) for r in wrong]}")
