"""Checks of phenotypes and of the structure of a model: aggregates over the records, one or two passes each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestock.functions.labels import is_missing_label

#: Numbers that files commonly hold for a missing observation.
MISSING_CODES = (-123456789.0, *(s * float("9" * n) for n in (5, 4, 3, 2, 1) for s in (-1, 1)))


def observed(name: str, missing_code: float | None = None) -> Column:
    """Whether a value counts as observed: finite and not the missing code."""
    col = F.col(name).cast("double")
    seen = col.isNotNull() & ~F.isnan(col) & (F.abs(col) != float("inf"))
    return seen if missing_code is None else seen & (F.abs(col - missing_code) >= 1e-9)


#: Values up to which one task may hold all that differ.
GATHERED = 1_000_000
BINS = 4096


def order_statistics(df: DataFrame, name: str, ranks: list[int]) -> dict[int, float]:
    """The values at these ranks (from 0) of the rows sorted by a column without nulls.

    The range is cut into BINS equal parts and counted, which tells the part a rank lies in; that part is cut
    again until it holds few values or one only. So no task sorts or holds all values.
    """
    value = F.col(name).cast("double")
    low, high = df.agg(F.min(value), F.max(value)).first()
    out: dict[int, float] = {}
    open_parts: list[tuple[float, float, int, list[int]]] = [(low, high, 0, sorted(set(ranks)))]
    while open_parts:
        low, high, before, wanted = open_parts.pop()
        rows = df.filter((value >= F.lit(low)) & (value <= F.lit(high)))
        step = (high - low) / BINS
        if low == high or step == 0:
            out |= dict.fromkeys(wanted, low)
            continue
        at = F.least(F.floor((value - F.lit(low)) / F.lit(step)), F.lit(BINS - 1))
        counts = rows.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).orderBy("at").collect()
        for r in counts:
            own = [k for k in wanted if before <= k < before + r.n]
            if own and (r.low == r.high or r.n <= GATHERED):
                found = [r.low] if r.low == r.high else [x[0] for x in df.filter((value >= F.lit(r.low)) & (value <= F.lit(r.high))).select(value).sort(value).collect()]
                out |= {k: found[0] if len(found) == 1 else found[k - before] for k in own}
            elif own:
                open_parts.append((r.low, r.high, before, own))
            before += r.n
    return out


def quantiles(df: DataFrame, name: str, probs: list[float]) -> tuple[int, list[float]]:
    """(number of values, linear quantiles of type 7) of a column without nulls."""
    n = df.count()
    if not n:
        return 0, [float("nan")] * len(probs)
    if n <= GATHERED:
        return n, list(df.agg(F.percentile(F.col(name), F.array(*map(F.lit, probs)))).first()[0])
    places = [(n - 1) * p for p in probs]
    at = order_statistics(df, name, [k for x in places for k in (int(x), min(int(x) + 1, n - 1))])
    return n, [at[int(x)] + (x - int(x)) * (at[min(int(x) + 1, n - 1)] - at[int(x)]) for x in places]


def fences(df: DataFrame, trait: str, fence: float = 3.0, by: str | None = None, missing_code: float | None = None) -> DataFrame:
    """Quartiles (linear, type 7) and Tukey fences of the observed values: one row, or one a class."""
    rows = df.filter(observed(trait, missing_code))
    if by is None and (n := rows.count()) > GATHERED:
        q = quantiles(rows, trait, [0.25, 0.75])[1]
        found = df.sparkSession.range(1).select(F.lit(n).cast("long").alias("n_observed"), F.array(*map(F.lit, q)).alias("_q"))
    else:
        found = (rows.groupBy(by) if by else rows.groupBy()).agg(F.count(F.lit(1)).alias("n_observed"), F.percentile(F.col(trait), F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    found = found.withColumn("q25", F.col("_q")[0]).withColumn("q75", F.col("_q")[1]).drop("_q")
    spread = (F.col("q75") - F.col("q25")) * fence
    return found.withColumn("low", F.col("q25") - spread).withColumn("high", F.col("q75") + spread)


@dataclass
class PhenotypeQC:
    """data: the records, outliers set missing; counts: n_rows, n_missing, n_outliers; small: classes with few observed records."""

    data: DataFrame
    counts: DataFrame
    small: dict[str, DataFrame]


def qc_phenotypes(df: DataFrame, trait: str, missing_code: float | None = None, classes: tuple[str, ...] = (), fence: float = 3.0, min_class_n: int = 2, fence_by: str | None = None, least_by: int = 8) -> PhenotypeQC:
    """Values beyond the fences become missing; rows stay. A class with at least `least_by` observed values has its own fences.

    A column that is not there or not numeric, fewer than two observed values and values that are all equal are errors.
    """
    if trait not in df.columns:
        raise ValueError(f"no column {trait}")
    if not isinstance(df.schema[trait].dataType, T.NumericType):
        raise TypeError(f"{trait} is not numeric")
    seen = observed(trait, missing_code)
    n, low, high = df.agg(F.count_if(seen), F.min(F.when(seen, F.col(trait))), F.max(F.when(seen, F.col(trait)))).first()
    if n < 2:
        raise ValueError(f"{trait} has {n} observed values")
    if low == high:
        raise ValueError(f"{trait} has no variance")
    whole = fences(df, trait, fence, None, missing_code).first()
    low, high = F.lit(whole.low), F.lit(whole.high)
    rows = df
    if fence_by:
        own = fences(df, trait, fence, fence_by, missing_code).filter(F.col("n_observed") >= least_by).select(F.col(fence_by).alias("_class"), F.col("low").alias("_low"), F.col("high").alias("_high"))
        rows = rows.join(own, F.col(fence_by).eqNullSafe(F.col("_class")), "left").drop("_class")
        low, high = F.coalesce("_low", low), F.coalesce("_high", high)
    out = seen & ((F.col(trait) < low) | (F.col(trait) > high))
    marked = rows.withColumn("_out", out).drop("_low", "_high")
    counts = marked.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~seen).alias("n_missing"), F.count_if("_out").alias("n_outliers"))
    gone = F.lit(missing_code).cast(df.schema[trait].dataType)
    data = marked.withColumn(trait, F.when(F.col("_out"), gone).otherwise(F.col(trait))).drop("_out")
    return PhenotypeQC(data, counts, {c: small_classes(data, trait, c, min_class_n, missing_code) for c in classes})


def standardized(df: DataFrame, names: list[str], trait: str | None = None) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """df with columns as deviations from their mean in standard deviations, over the rows whose trait is observed, and (mean, deviation) by column, by which slopes are brought back."""
    used = df.filter(observed(trait)) if trait else df
    row = used.agg(*[f(F.col(n).cast("double")) for n in names for f in (F.avg, F.stddev_samp)]).first()
    moments = {n: (row[2 * k], row[2 * k + 1]) for k, n in enumerate(names)}
    if flat := [n for n, (_, sd) in moments.items() if not sd]:
        raise ValueError(f"columns without variance: {flat}")
    return df.withColumns({n: (F.col(n).cast("double") - mean) / sd for n, (mean, sd) in moments.items()}), moments


def small_classes(df: DataFrame, trait: str, by: str, least: int = 2, missing_code: float | None = None) -> DataFrame:
    """Levels with fewer than `least` observed records; a level whose records are all missing counts as 0."""
    counts = df.groupBy(by).agg(F.count_if(observed(trait, missing_code)).alias("n_observed"))
    return counts.filter(F.col("n_observed") < least)


def missing_labels(df: DataFrame, names: list[str]) -> DataFrame:
    """One row a level column: how many rows have no label."""
    counts = df.agg(*[F.count_if(is_missing_label(df, n)).alias(n) for n in names])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("column", "n_missing"))


def robust_scale(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Median and robust standard deviation: from the median absolute deviation, that of values off the median if it is 0, then the mean one."""
    keys = [by] if by else []
    centre = df.filter(F.col(name).isNotNull()).groupBy(*keys).agg(F.median(name).alias("centre"))
    rows = (df.join(centre, by) if by else df.crossJoin(F.broadcast(centre))).withColumn("_d", F.abs(F.col(name) - F.col("centre")))
    spread = rows.groupBy(*keys, "centre").agg(F.median("_d").alias("_mad"), F.median(F.when(F.col("_d") > 0, F.col("_d"))).alias("_off"), F.avg("_d").alias("_mean"))
    scale = F.when(F.col("_mad") > 0, F.col("_mad") * 1.4826).when(F.col("_off") > 0, F.col("_off") * 1.4826).otherwise(F.col("_mean") * 1.2533141373155003)
    return spread.select(*keys, "centre", scale.alias("scale"))


def suspicious_values(df: DataFrame, name: str, codes: tuple[float, ...] = MISSING_CODES) -> DataFrame:
    """Codes that look like missing values: held at least twice, outside the range of the rest, three robust deviations or more from it."""
    known = F.col(name).isin(*codes)
    rest = df.filter(~known & F.col(name).isNotNull())
    bounds = rest.agg(F.min(name).alias("_low"), F.max(name).alias("_high")).crossJoin(robust_scale(rest, name))
    held = df.filter(known).groupBy(F.col(name).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    beyond = ((F.col("code") < F.col("_low")) | (F.col("code") > F.col("_high"))) & (F.abs(F.col("code") - F.col("centre")) >= F.col("scale") * 3)
    return held.filter("n >= 2").crossJoin(F.broadcast(bounds)).filter(beyond).select("code", "n")  # at most one row a code


def outlying_values(df: DataFrame, name: str, deviations: float = 10.0) -> DataFrame:
    """Rows further than so many robust deviations from the median."""
    scale = F.broadcast(robust_scale(df, name))
    return df.crossJoin(scale).filter(F.abs(F.col(name) - F.col("centre")) > F.col("scale") * deviations).drop("centre", "scale")


def is_nested(df: DataFrame, fixed: str, term: str) -> DataFrame:
    """One row: levels of the fixed class, those that hold a single level of the term, and whether all do."""
    per = df.groupBy(fixed).agg(F.min(term).alias("_a"), F.max(term).alias("_b"))
    return per.agg(F.count(F.lit(1)).alias("n_fixed"), F.count_if(F.col("_a") == F.col("_b")).alias("n_single")).withColumn("nested", F.col("n_fixed") == F.col("n_single"))


def repeated_records(df: DataFrame, by: str) -> DataFrame:
    """One row: levels, levels with more than one record, and the largest number of records."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).agg(F.count(F.lit(1)).alias("n_levels"), F.count_if(F.col("_n") > 1).alias("n_repeated"), F.max("_n").alias("most"))


def level_counts(df: DataFrame, names: list[str], least: int = 5) -> DataFrame:
    """One row a column: its number of levels and whether there are few. Columns are counted one job each, with no expansion of rows."""
    parts = [df.select(F.col(n).cast("string").alias("level")).filter(F.col("level").isNotNull() & (F.col("level") != "0")).distinct().agg(F.count(F.lit(1)).alias("n_levels")).select(F.lit(n).alias("column"), "n_levels") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("few", F.col("n_levels") < least)


def collinear_pairs(df: DataFrame, names: list[str]) -> DataFrame:
    """Correlation of each pair of columns over rows that have both, and whether it is one in size."""
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs], *[F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"n|{a}|{b}") for a, b in pairs])
    made = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r"), F.col(f"n|{a}|{b}").alias("n")) for a, b in pairs])
    return row.select(F.inline(made)).withColumn("collinear", (F.abs("r") > 1 - 1e-10) & (F.col("n") >= 3))
