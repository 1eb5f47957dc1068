"""Gibbs sampling of mixed models, a task a chain, and diagnostics of chains."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestock.operators.likelihood import Likelihood, likelihood
from lodestock.operators.mixed import relationship_levels
from lodestock.operators.quality import quantiles
from lodestock.plans.design import DRIVER_COLUMNS, build, level_statistics, statistics
from lodestock.plans.formula import parse
from lodestock.session import written


@dataclass(frozen=True)
class HalfT:
    """Half-t prior on standard deviations: degrees of freedom and scale (a multiple of the trait's own deviation)."""

    df: float = 2.0
    scale: float = 1.0


def half_t(df: float = 2.0, scale: float = 1.0) -> HalfT:
    if df <= 0 or scale <= 0:
        raise ValueError("df and scale must be positive")
    return HalfT(df, scale)


def _inverse_wishart(rng: np.random.Generator, df: float, scale: np.ndarray) -> np.ndarray:
    """A draw by Bartlett's decomposition of the Wishart of the inverse."""
    d = len(scale)
    lower = np.linalg.cholesky(np.linalg.inv(scale))
    a = np.tril(rng.normal(size=(d, d)), -1)
    a[np.diag_indices(d)] = np.sqrt(rng.chisquare(df - np.arange(d)))
    half = np.linalg.inv(lower @ a)
    return half.T @ half


def _sample(lik: Likelihood, prior: str | HalfT, n_iter: int, burnin: int, thin: int, seed: int, fixed: np.ndarray | None) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    kept = lik.kept
    theta = lik.start() if fixed is None else fixed
    *covs, r0 = lik.matrices(theta)
    (mask, s), *rest = lik.patterns.items()
    if rest or lik.traits != 1:
        raise ValueError("one trait is sampled at a time")
    aux = [np.ones(len(c)) for c in covs]
    spread = math.sqrt(lik.variance(0))
    rows = []
    for k in range(n_iter):
        sol = lik.draw(lik.vector([*covs, r0]), rng)
        if fixed is None:
            ee = lik.squares(sol)
            r0 = np.array([[max(ee, 1e-300) / rng.chisquare(s.n - 2)]])
            for g, cov in enumerate(covs):
                d, n = len(cov), lik.design.groups[g].n
                u = np.stack([sol[lik._columns(g, a)] for a in range(d)], 1)
                q = lik.forms(g, u)
                own: str | HalfT = prior
                if prior == "flat" and n <= 2 * d + 2:
                    raise ValueError(f"{lik.design.groups[g].name} has {n} levels: under a flat prior its covariance has no proper posterior; use half_t()")
                if isinstance(own, HalfT):
                    inverse = np.linalg.inv(cov)
                    scale = own.scale * spread
                    aux[g] = 2 * (own.df * np.diag(inverse) + 1 / scale**2) / rng.chisquare(own.df + d, d)
                    covs[g] = _inverse_wishart(rng, n + own.df + d - 1, q + 2 * own.df * np.diag(1 / aux[g]))
                elif own == "jeffreys":
                    covs[g] = _inverse_wishart(rng, n, q)
                elif own == "uniform_sd":
                    covs[g] = _inverse_wishart(rng, n - 1, q)
                elif own == "flat":
                    covs[g] = _inverse_wishart(rng, n - d - 1, q)
                else:
                    raise ValueError(f"no prior {prior}")
        if k >= burnin and (k - burnin) % thin == 0:
            rows.append([*lik.vector([*covs, r0]), *(sol[kept] if fixed is not None else [])])
    names = [*lik.names, *([f"b[{c}]" for c in kept] if fixed is not None else [])]
    return pd.DataFrame(rows, columns=names)


def gibbs(formula: str, df: DataFrame, pedigree: DataFrame | None = None, n_iter: int = 2000, burnin: int = 500, thin: int = 5, chains: int = 4, prior: str | HalfT = "flat", seed: int = 1, theta: dict[str, float] | None = None) -> DataFrame:
    """(chain, iteration, parameter, value): draws of the components (of the locations too, if theta holds the components fixed).

    The sums of products are computed once, by Spark; each chain is then a task of its own, and one that
    is lost is drawn again from its own seed with the same result.
    """
    f = parse(formula)
    fam = relationship_levels(df, f, pedigree)
    design = build(df, f, fam.ids if fam else None)
    related = len(fam) if fam else 0
    apart = design.cells.apart(f, DRIVER_COLUMNS - related, related)
    statistics(design) if apart is None else level_statistics(design, apart)
    related = fam.inverse() if fam else None
    design.cells = None  # tasks get the sums only
    lik = likelihood(design, [related if g.relationship else None for g in design.groups])
    fixed = None if theta is None else np.array([theta.get(n, 0.0) for n in lik.names])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chain in batch["id"].tolist():
                draws = _sample(lik, prior, n_iter, burnin, thin, seed * 1000 + chain, fixed)
                long = draws.reset_index(names="iteration").melt("iteration", var_name="parameter", value_name="value")
                yield long.assign(chain=chain)[["chain", "iteration", "parameter", "value"]]

    rows = df.sparkSession.range(0, chains, 1, chains).mapInPandas(run, "chain long, iteration long, parameter string, value double")
    return written(rows, "draws")


def probit_gibbs(y: np.ndarray, x: np.ndarray, groups: np.ndarray, n_iter: int = 1500, burnin: int = 500, seed: int = 1) -> np.ndarray:
    """Draws of the variance of group effects of a 0/1 trait on the liability scale (residual variance 1)."""
    rng = np.random.default_rng(seed)
    unit, n_groups = NormalDist(), int(groups.max()) + 1
    z = np.eye(n_groups)[groups]
    w = np.hstack([x, z])
    ww, sol, var, out = w.T @ w, np.zeros(w.shape[1]), 1.0, []
    for k in range(n_iter):
        mean = w @ sol
        cut = np.array([unit.cdf(-m) for m in mean])
        u = rng.random(len(y))
        p = np.clip(np.where(y == 1, cut + u * (1 - cut), u * cut), 1e-12, 1 - 1e-12)
        liability = mean + np.array([unit.inv_cdf(v) for v in p])
        c = ww + np.diag(np.r_[np.full(x.shape[1], 1e-2), np.full(n_groups, 1 / var)])
        lower = np.linalg.cholesky(c)
        sol = np.linalg.solve(lower.T, np.linalg.solve(lower, w.T @ liability) + rng.normal(size=len(sol)))
        effects = sol[x.shape[1] :]
        slack = 2 * (4 / var + 1) / rng.chisquare(5)  # half-t with four degrees of freedom
        var = (effects @ effects + 8 / slack) / rng.chisquare(n_groups + 4)
        if k >= burnin:
            out.append(var)
    return np.array(out)


def _split(x: np.ndarray) -> np.ndarray:
    n = x.shape[1] // 2
    return np.concatenate([x[:, :n], x[:, -n:]])


#: Wichura's AS241, as statistics.NormalDist has it; numerators and denominators, highest power first.
_CENTRE = ((2509.0809287301227, 33430.57558358813, 67265.7709270087, 45921.95393154987, 13731.69376550946, 1971.5909503065513, 133.14166789178438, 3.3871328727963665), (5226.495278852854, 28729.085735721943, 39307.89580009271, 21213.794301586597, 5394.196021424751, 687.1870074920579, 42.31333070160091, 1.0))
_NEAR_TAIL = ((0.0007745450142783414, 0.022723844989269184, 0.2417807251774506, 1.2704582524523684, 3.6478483247632045, 5.769497221460691, 4.630337846156546, 1.4234371107496835), (1.0507500716444169e-09, 0.0005475938084995345, 0.015198666563616457, 0.14810397642748008, 0.6897673349851, 1.6763848301838038, 2.053191626637759, 1.0))
_FAR_TAIL = ((2.0103343992922881e-07, 2.7115555687434876e-05, 0.0012426609473880784, 0.026532189526576124, 0.29656057182850487, 1.7848265399172913, 5.463784911164114, 6.657904643501103), (2.0442631033899397e-15, 1.421511758316446e-07, 1.8463183175100548e-05, 0.0007868691311456133, 0.014875361290850615, 0.1369298809227358, 0.599832206555888, 1.0))


def normal_quantiles(p: np.ndarray) -> np.ndarray:
    """NormalDist().inv_cdf of an array."""
    q = p - 0.5
    ratio = lambda c, r: np.polyval(c[0], r) / np.polyval(c[1], r)
    out = np.empty_like(q)
    centre = np.abs(q) <= 0.425
    at = q[centre]
    out[centre] = ratio(_CENTRE, 0.180625 - at * at) * at
    outer = ~centre
    if outer.any():
        r = np.sqrt(-np.log(np.where(q[outer] <= 0, p[outer], 1 - p[outer])))
        out[outer] = np.where(r <= 5, ratio(_NEAR_TAIL, r - 1.6), ratio(_FAR_TAIL, r - 5)) * np.sign(q[outer])
    return out


def _normal_ranks(x: np.ndarray) -> np.ndarray:
    """Normal scores of ranks, ties at their mean. Besides x it holds three arrays of its size."""
    flat = x.ravel()
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    start = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    del ordered
    length = np.diff(np.r_[start, len(flat)])
    score = normal_quantiles((start + (length + 1) / 2 - 0.375) / (len(flat) + 0.25))
    out = np.empty(len(flat))
    out[order] = score if len(score) == len(flat) else np.repeat(score, length)
    return out.reshape(x.shape)


def _plain_rhat(x: np.ndarray) -> float:
    n = x.shape[1]
    within, between = x.var(1, ddof=1).mean(), n * x.mean(1).var(ddof=1) if len(x) > 1 else 0.0
    return float(math.sqrt(((n - 1) / n * within + between / n) / within)) if within > 0 else math.nan


def rhat(x: np.ndarray) -> float:
    """Rank-normalised split R-hat: the larger of bulk and tail, the distances from the median of all draws. x: chains x draws."""
    x = np.atleast_2d(x)
    bulk = _plain_rhat(_normal_ranks(_split(x)))
    return max(bulk, _plain_rhat(_normal_ranks(_split(np.abs(x - np.median(x))))))


def _autocovariance(x: np.ndarray) -> np.ndarray:
    n = len(x)
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(x - x.mean(), size)
    return np.fft.irfft(f * np.conj(f), size)[:n] / n


def ess(x: np.ndarray) -> float:
    """Effective sample size of pooled chains: Geyer's initial positive sequence of paired autocorrelations, made monotone, and the even lag after it."""
    x = np.atleast_2d(x)
    m, n = x.shape
    if n < 3 or not np.isfinite(x).all() or x.max() == x.min():
        return math.nan
    cov = np.zeros(n)
    for c in x:  # one at a time: a chain is long
        cov += _autocovariance(c)
    cov /= m
    within = cov[0] * n / (n - 1)
    total = cov[0] + (x.mean(1).var(ddof=1) if m > 1 else 0.0)
    rho = 1 - (within - cov) / total
    rho[0] = 1.0
    pairs = rho[: n // 2 * 2].reshape(-1, 2).sum(1)
    # pairs are taken up to the first that is not positive, or as far as the chain is long enough to tell
    end, last = 0, max(0, -(-(n - 5) // 2))
    while end < min(last, len(pairs) - 1) and pairs[end] > 0:
        end += 1
    even = rho[2 * end] if end == 0 or pairs[end] >= 0 or rho[2 * end] > 0 else 0.0
    summed = np.minimum.accumulate(pairs[:end]).sum() if end else 1.0
    return float(m * n / max(2 * summed - 1 + even, 1 / math.log10(m * n)))


def ess_quantile(x: np.ndarray, p: float) -> float:
    """The effective sample size of the indicator of values up to the quantile p."""
    return ess(_split((np.atleast_2d(x) <= np.quantile(x, p)).astype(float)))


def mcse(x: np.ndarray) -> float:
    """Standard error of the mean of the draws."""
    return float(np.std(x, ddof=1) / math.sqrt(ess(_split(np.atleast_2d(x)))))


def mcse_sd(x: np.ndarray) -> float:
    """Standard error of the standard deviation of the draws, by that of their squared distances from the mean."""
    square = (np.atleast_2d(x) - np.mean(x)) ** 2
    mean = square.mean()
    return float(math.sqrt(((square**2).mean() - mean**2) / ess(_split(square)) / mean / 4))


def pairwise_rhat(x: np.ndarray) -> np.ndarray:
    """R-hat of each pair of chains; a chain whose smallest one is large agrees with no other."""
    x = np.atleast_2d(x)
    out = np.full((len(x), len(x)), math.nan)
    for i in range(len(x)):
        for j in range(i):
            out[i, j] = out[j, i] = rhat(x[[i, j]])
    return out


def pareto_k(x: np.ndarray) -> float:
    """The larger shape of generalised Pareto distributions fitted to both tails of the draws (Zhang and Stephens' estimator, shrunk to one half as by ten draws)."""
    flat = np.sort(np.ravel(x))
    size = len(flat)
    n = math.ceil(min(0.2 * size, 3 * math.sqrt(size)))
    if n < 5 or flat[0] == flat[-1]:
        return math.nan
    found = []
    for tail in (flat[-n:] - flat[-n - 1], (flat[n] - flat[:n])[::-1]):
        tail = np.maximum(tail, 1e-300)
        grid = 30 + int(math.sqrt(n))
        quarter = tail[int(n / 4 + 0.5) - 1]
        b = 1 / tail[-1] + (1 - np.sqrt(grid / (np.arange(1, grid + 1) - 0.5))) / (3 * quarter)
        k = np.log1p(-b[:, None] * tail[None, :]).mean(1)
        value = n * (np.log(-b / k) - k - 1)
        weight = 1 / np.exp(value[None, :] - value[:, None]).sum(1)
        best = float(weight @ b)
        shape = float(np.log1p(-best * tail).mean())
        found.append((n * shape + 10 * 0.5) / (n + 10))
    return max(found)


def boundary_share(draws: np.ndarray, least: float = 1e-6) -> float:
    """Share of drawn covariance matrices (draws x d x d) whose correlations have an eigenvalue under `least`."""
    scale = np.sqrt(np.maximum(np.diagonal(draws, axis1=1, axis2=2), 1e-300))
    return float((np.linalg.eigvalsh(draws / (scale[:, :, None] * scale[:, None, :]))[:, 0] < least).mean())


def geweke_z(x: np.ndarray, first: float = 0.1, last: float = 0.5) -> float:
    """Difference of the means of the first and the last part of the chains, in standard errors whose spectral density is the last part's."""
    x = np.atleast_2d(x)
    n = x.shape[1]
    a, b = x[:, : max(1, int(first * n))], x[:, n - int(last * n) :]
    s = np.mean([np.var(c, ddof=1) * len(c) / ess(c) for c in b])
    return float((a.mean() - b.mean()) / math.sqrt(s / a.size + s / b.size))


def heidelberger_welch(x: np.ndarray, steps: int = 10) -> tuple[bool, int]:
    """(stationary, draws to drop): the Cramer-von Mises test at 5 per cent on ever shorter chains."""
    n = len(x)
    half = x[n // 2 :] - x[n // 2 :].mean()
    rho = float(half[1:] @ half[:-1] / max(half @ half, 1e-300))
    density = np.var(half, ddof=1) * (1 + rho) / max(1 - rho, 1e-6)  # at frequency zero, of a first-order autoregression
    for k in range(steps // 2 + 1):
        y = x[k * n // steps :]
        bridge = (np.cumsum(y) - np.arange(1, len(y) + 1) * y.mean()) / math.sqrt(len(y) * density)
        if (bridge**2).mean() < 0.461:
            return True, k * n // steps
    return False, n


def multivariate_ess(x: np.ndarray) -> float:
    """Draws x parameters: from the determinants of the covariance and of that of batch means."""
    n, p = x.shape
    b = max(2, int(math.sqrt(n)))
    k = n // b
    means = x[: k * b].reshape(k, b, p).mean(1)
    a = np.linalg.slogdet(np.cov(x.T).reshape(p, p))[1]
    s = np.linalg.slogdet(b * np.cov(means.T).reshape(p, p))[1]
    return float(n * math.exp((a - s) / p))


def multivariate_rhat(x: np.ndarray) -> float:
    """Chains x draws x parameters: the largest ratio of between to within covariance over directions."""
    m, n, p = x.shape
    within = np.mean([np.cov(c.T).reshape(p, p) for c in x], axis=0)
    between = np.cov(x.mean(1).T).reshape(p, p)
    top = np.linalg.eigvals(np.linalg.solve(within, between)).real.max()
    return float(math.sqrt((n - 1) / n + (m + 1) / m * top))


def diagnostics(draws: DataFrame, probs: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """One row a parameter: mean, sd, quantiles, rhat, ess (of normal scores), tail ess, mcse of mean and sd, the tails' shape, the largest of the chains' smallest pairwise R-hats, geweke, verdict.

    A chain of a parameter is made one array in a task, and a parameter's chains meet in one task, which holds a
    few arrays of their size: some 50 bytes a draw.
    """
    schema = "parameter string, mean double, sd double, low double, high double, rhat double, ess double, tail_ess double, mcse double, mcse_sd double, pareto_k double, isolated double, geweke double, verdict string"

    def chain_of(table: pa.Table) -> pa.Table:
        order, value = np.argsort(np.asarray(table["iteration"])), np.asarray(table["value"].combine_chunks())
        return pa.table({"parameter": table["parameter"][:1], "chain": table["chain"][:1], "values": pa.array([value[order].tobytes()], pa.binary())})

    def one(table: pa.Table) -> pa.Table:
        name = table["parameter"][0].as_py()
        x = np.stack([np.frombuffer(v.as_buffer()) for v in table.sort_by("chain")["values"]])
        del table
        low, high = np.quantile(x, probs)
        r, e, g = rhat(x), ess(_normal_ranks(_split(x))), geweke_z(x)
        tail = min(ess_quantile(x, p) for p in probs)
        apart = float(np.nanmin(pairwise_rhat(x), axis=1).max()) if len(x) > 1 else math.nan
        verdict = "not mixed" if r > 1.05 or apart > 1.05 else "burn-in" if abs(g) > 3 else "run longer" if r > 1.01 or min(e, tail) < 100 * len(x) else "ok"
        row = [name, x.mean(), x.std(ddof=1), low, high, r, e, tail, mcse(x), mcse_sd(x), pareto_k(x), apart, g, verdict]
        return pa.table({f.split()[0]: [v if isinstance(v, str) else float(v)] for f, v in zip(schema.split(", "), row, strict=True)})

    rows = draws.select("parameter", F.col("chain").cast("long").alias("chain"), F.col("iteration").cast("long").alias("iteration"), F.col("value").cast("double").alias("value"))
    chains = rows.groupBy("parameter", "chain").applyInArrow(chain_of, "parameter string, chain long, values binary")
    return chains.groupBy("parameter").applyInArrow(one, schema)


def moments(draws: DataFrame, probs: tuple[float, float] = (0.05, 0.95), most: int = 20) -> DataFrame:
    """(parameter, mean, sd, low, high) by aggregates, as diagnostics() has them; of up to `most` parameters without a task that holds all draws of one."""
    of = [F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")]
    names = [r.parameter for r in draws.select("parameter").distinct().limit(most + 1).collect()]
    if len(names) > most:
        q = F.percentile("value", F.array(*map(F.lit, probs)))
        return draws.groupBy("parameter").agg(*of, q.alias("_q")).select("parameter", "mean", "sd", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))
    found = []
    for name in names:
        low, high = quantiles(draws.filter(F.col("parameter") == name), "value", list(probs))[1]
        found.append((name, float(low), float(high)))
    both = draws.sparkSession.createDataFrame(found, "parameter string, low double, high double")
    return draws.groupBy("parameter").agg(*of).join(both, "parameter").select("parameter", "mean", "sd", "low", "high")


def classic_rhat(draws: DataFrame) -> DataFrame:
    """(parameter, rhat) by two aggregations: chain means and variances, then their spread. Chains of equal length."""
    per = draws.groupBy("parameter", "chain").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    both = per.groupBy("parameter").agg(F.max("n").alias("n"), F.avg("v").alias("w"), F.var_samp("m").alias("b"))
    return both.select("parameter", F.sqrt((F.col("n") - 1) / F.col("n") + F.col("b") / F.col("w")).alias("rhat"))


def worst_levels(draws: DataFrame, most: int = 10) -> DataFrame:
    """The parameters whose chains agree least: (parameter, rhat), the largest first."""
    return classic_rhat(draws).orderBy(F.desc("rhat"), "parameter").limit(most)


def numbered(df: DataFrame, chain, order: str, value: str) -> DataFrame:
    """(chain, iteration, parameter, value) of any table: chain by an expression, iterations in the order of a column."""
    rows = df.select(chain.alias("chain"), F.col(order).alias("_o"), F.lit(value).alias("parameter"), F.col(value).cast("double").alias("value"))
    return rows.select("chain", F.row_number().over(Window.partitionBy("chain").orderBy("_o")).cast("long").alias("iteration"), "parameter", "value")


def chain_arrays(draws: DataFrame) -> dict[str, np.ndarray]:
    """Parameter -> chains x draws, for libraries that read arrays."""
    pdf = draws.toPandas().sort_values(["parameter", "chain", "iteration"])
    return {p: np.stack([c["value"].to_numpy() for _, c in g.groupby("chain")]) for p, g in pdf.groupby("parameter")}
