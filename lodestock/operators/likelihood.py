"""Restricted likelihood of a mixed model from its sufficient statistics.

One or more traits, any pattern of missing ones, groups with covariance C and inverse relationship K, terms of
some traits only, and residual covariance R, of all records or of each residual class. Value, score, average
information, solutions and prediction error variances all come from the sums of products; no record is looked
at again. The levels of one group that is independent by level are eliminated first, each by itself
(LevelLikelihood), so their number costs no square matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lodestock.plans.design import Design, LevelStatistics, Statistics, independent


@dataclass
class Parameter:
    """One component: of a group (None: residual, of class `block`), at row a and column b of its matrix."""

    name: str
    group: int | None
    a: int
    b: int
    block: int = 0


@dataclass
class Evaluation:
    theta: np.ndarray
    neg2logl: float
    score: np.ndarray
    information: np.ndarray
    solution: np.ndarray
    inverse: "np.ndarray | LevelInverse"
    em: np.ndarray


class Likelihood:
    #: The group whose levels are eliminated first; none here.
    absorbed: int | None = None

    def __init__(self, design: Design, patterns: dict[tuple, Statistics], kinv: list[np.ndarray | None]) -> None:
        self.design, self.patterns = design, patterns
        traits = design.formula.traits
        self.traits = t = len(traits)
        width = design.width
        #: By group, the (trait, coefficient) that its matrix is over.
        self.pairs = [[(k, c) for k in range(t) for c in range(g.dim) if not (g.traits and g.traits[c]) or traits[k] in g.traits[c]] for g in design.groups]
        keep = np.zeros((t, width), bool)
        for k in range(t):
            xx = sum((s.ww[: design.p, : design.p] for m, s in patterns.items() if m[k]), np.zeros((design.p, design.p)))
            own = [not (design.fixed_traits and design.fixed_traits[c]) or traits[k] in design.fixed_traits[c] for c in range(design.p)]
            keep[k, : design.p] = independent(np.where(np.outer(own, own), xx, 0.0))
        for g, group in enumerate(design.groups):
            for k, c in self.pairs[g]:
                keep[k, group.columns(c)] = True
        self.kept = np.flatnonzero(keep.ravel())
        self.rank = int(keep[:, : design.p].sum())
        self.kinv = [(None if n == self.absorbed else np.eye(g.n)) if k is None else k for n, (g, k) in enumerate(zip(design.groups, kinv, strict=True))]
        self.log_kinv = [0.0 if k is None else np.linalg.slogdet(k)[1] for k in kinv]
        self.parameters: list[Parameter] = []
        at = (lambda name, k: name) if t == 1 else (lambda name, k: f"{name}@{traits[k]}")
        for g, group in enumerate(design.groups):
            self._add([at(group.names[c], k) for k, c in self.pairs[g]], g)
        self.blocks = max(1, len(design.classes))
        for block in range(self.blocks):
            name = f"residual|{design.classes[block]}" if design.classes else "residual"
            self._add([name] if t == 1 else [f"{name.replace('residual', 'res')}@{y}" for y in traits], None, block)
        self.sizes = [*map(len, self.pairs), *[t] * self.blocks]
        #: Records by residual class.
        self.counts = np.array([sum(s.n for s in patterns.values() if s.block == block) for block in range(self.blocks)])

    def _add(self, names: list[str], group: int | None, block: int = 0) -> None:
        for b in range(len(names)):
            for a in range(b, len(names)):
                self.parameters.append(Parameter(f"var({names[a]})" if a == b else f"cov({names[a]},{names[b]})", group, a, b, block))

    def split(self, theta: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The groups' matrices and the residual ones."""
        every = self.matrices(theta)
        return every[: len(self.pairs)], every[len(self.pairs) :]

    def residual(self, theta: np.ndarray) -> np.ndarray:
        """The residual matrix; of several classes the mean over the records."""
        return np.tensordot(self.counts / max(1, self.counts.sum()), np.stack(self.split(theta)[1]), 1)

    def _place(self, p: Parameter) -> int:
        return len(self.pairs) + p.block if p.group is None else p.group

    @property
    def names(self) -> list[str]:
        return [p.name for p in self.parameters]

    def matrices(self, theta: np.ndarray) -> list[np.ndarray]:
        out = [np.zeros((s, s)) for s in self.sizes]
        for p, v in zip(self.parameters, theta, strict=True):
            m = out[self._place(p)]
            m[p.a, p.b] = m[p.b, p.a] = v
        return out

    def vector(self, matrices: list[np.ndarray]) -> np.ndarray:
        return np.array([matrices[self._place(p)][p.a, p.b] for p in self.parameters])

    def valid(self, theta: np.ndarray, floor: float = 1e-10) -> bool:
        scale = self.spread()
        return all(np.linalg.eigvalsh(m)[0] > floor * scale for m in self.matrices(theta))

    def spread(self) -> float:
        """Mean variance of the traits, for floors."""
        return float(np.mean([self.variance(k) for k in range(self.traits)]))

    def variance(self, trait: int) -> float:
        n = sum(s.n for m, s in self.patterns.items() if m[trait])
        yy = sum(s.yy[trait, trait] for m, s in self.patterns.items() if m[trait])
        y = sum(s.wy[0, trait] for m, s in self.patterns.items() if m[trait])
        w = sum(s.ww[0, 0] for m, s in self.patterns.items() if m[trait])
        return (yy - y * y / w) / max(1, n - 1)

    def start(self) -> np.ndarray:
        """Half the variance to the residual, the rest in equal parts to the groups; no covariances."""
        out = [np.zeros((s, s)) for s in self.sizes]
        for k in range(self.traits):
            v = self.variance(k)
            own = [g for g, pairs in enumerate(self.pairs) if any(j == k for j, _ in pairs)]
            for block in range(self.blocks):
                out[len(self.pairs) + block][k, k] = v / 2 if own else v
            for g in own:
                places = [a for a, (j, _) in enumerate(self.pairs[g]) if j == k]
                for a in places:
                    out[g][a, a] = v / 2 / len(own) / len(places)
        return self.vector(out)

    def _columns(self, g: int, a: int) -> slice:
        group, width = self.design.groups[g], self.design.width
        trait, c = self.pairs[g][a]
        s = group.columns(c)
        return slice(trait * width + s.start, trait * width + s.stop)

    def _residual_inverse(self, r0: np.ndarray, mask: tuple) -> np.ndarray:
        own = np.flatnonzero(mask[: self.traits])
        out = np.zeros_like(r0)
        out[np.ix_(own, own)] = np.linalg.inv(r0[np.ix_(own, own)])
        return out

    def equations(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Coefficients without and with the groups' precision, right-hand side, and y'R^-1 y."""
        covs, rs = self.split(theta)
        size = self.traits * self.design.width
        data, rhs, yy = np.zeros((size, size)), np.zeros(size), 0.0
        for m, s in self.patterns.items():
            ri = self._residual_inverse(rs[s.block], m)
            data += np.kron(ri, s.ww)
            rhs += (s.wy @ ri).T.ravel()
            yy += float((ri * s.yy).sum())
        full = data.copy()
        for g, cov in enumerate(covs):
            inv = np.linalg.inv(cov)
            for a in range(len(cov)):
                for b in range(len(cov)):
                    full[self._columns(g, a), self._columns(g, b)] += inv[a, b] * self.kinv[g]
        return data, full, rhs, yy

    def value(self, theta: np.ndarray) -> float:
        """-2 log L alone."""
        return self._solve(theta)[0]

    def _solve(self, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        covs, rs = self.split(theta)
        data, full, rhs, yy = self.equations(theta)
        c = full[np.ix_(self.kept, self.kept)]
        sol = np.zeros(len(rhs))
        sol[self.kept] = np.linalg.solve(c, rhs[self.kept])
        total = np.linalg.slogdet(c)[1] + yy - sol @ rhs
        for m, s in self.patterns.items():
            own = np.flatnonzero(m[: self.traits])
            total += s.n * np.linalg.slogdet(rs[s.block][np.ix_(own, own)])[1]
        for g, cov in enumerate(covs):
            total += self.design.groups[g].n * np.linalg.slogdet(cov)[1] - len(cov) * self.log_kinv[g]
        return float(total), sol, c, data

    def draw(self, theta: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Locations drawn from their distribution given the components."""
        _, full, rhs, _ = self.equations(theta)
        lower = np.linalg.cholesky(full[np.ix_(self.kept, self.kept)])
        sol = np.zeros(len(rhs))
        sol[self.kept] = np.linalg.solve(lower.T, np.linalg.solve(lower, rhs[self.kept]) + rng.normal(size=len(self.kept)))
        return sol

    def squares(self, sol: np.ndarray) -> float:
        """Sum of squared residuals of one trait with one pattern."""
        (s,) = self.patterns.values()
        return float(s.yy[0, 0] - 2 * sol @ s.wy[:, 0] + sol @ s.ww @ sol)

    def forms(self, g: int, u: np.ndarray) -> np.ndarray:
        """u' K^-1 u for effects (levels x coefficients) of a group."""
        return u.T @ u if self.kinv[g] is None else u.T @ self.kinv[g] @ u

    def evaluate(self, theta: np.ndarray) -> Evaluation:
        covs, rs = self.split(theta)
        width = self.design.width
        total, sol, c, data = self._solve(theta)
        inverse = np.zeros((len(sol), len(sol)))
        inverse[np.ix_(self.kept, self.kept)] = np.linalg.inv(c)
        by_trait = sol.reshape(self.traits, width)
        q, t = [], []
        for g, cov in enumerate(covs):
            d = len(cov)
            u = [sol[self._columns(g, a)] for a in range(d)]
            q.append(np.array([[u[a] @ self.kinv[g] @ u[b] for b in range(d)] for a in range(d)]))
            t.append(np.array([[(self.kinv[g] * inverse[self._columns(g, a), self._columns(g, b)]).sum() for b in range(d)] for a in range(d)]))
        ee, ss, we, ris = {}, {}, {}, {}
        for m, s in self.patterns.items():
            ris[m] = self._residual_inverse(rs[s.block], m)
            fit = by_trait @ s.ww
            cross = by_trait @ s.wy
            ee[m] = s.yy - cross - cross.T + fit @ by_trait.T
            ss[m] = np.array([[(inverse[a * width : (a + 1) * width, b * width : (b + 1) * width] * s.ww).sum() for b in range(self.traits)] for a in range(self.traits)])
            we[m] = s.wy - fit.T
        score, works, squares = np.zeros(len(theta)), [], []
        residuals: list[dict] = []
        for k, p in enumerate(self.parameters):
            if p.group is not None:
                cov = covs[p.group]
                e = np.zeros_like(cov)
                e[p.a, p.b] = e[p.b, p.a] = 1
                inv = np.linalg.inv(cov)
                score[k] = self.design.groups[p.group].n * np.trace(inv @ e) - np.trace(inv @ e @ inv @ (q[p.group] + t[p.group]))
                mix = e @ inv
                m_k = np.zeros(len(sol))
                for a in range(len(cov)):
                    m_k[self._columns(p.group, a)] = sum(mix[a, b] * sol[self._columns(p.group, b)] for b in range(len(cov)))
                works.append(data @ m_k)
                residuals.append({"m": m_k})
            else:
                e = np.zeros((self.traits, self.traits))
                e[p.a, p.b] = e[p.b, p.a] = 1
                work, parts = np.zeros((self.traits, width)), {}
                for m, s in self.patterns.items():
                    if s.block != p.block:
                        continue
                    ri = ris[m]
                    score[k] += s.n * np.trace(ri @ e) - np.trace(ri @ e @ ri @ (ee[m] + ss[m]))
                    parts[m] = ri @ e @ ri
                    work += (we[m] @ parts[m]).T
                works.append(work.ravel())
                residuals.append({"r": parts, "e": e})
        info = np.zeros((len(theta), len(theta)))
        for i, a in enumerate(residuals):
            for j, b in enumerate(residuals[: i + 1]):
                if "m" in a and "m" in b:
                    own = a["m"] @ works[j]
                elif "r" in a and "r" in b:
                    own = sum(np.trace(a["r"][m] @ b["e"] @ ris[m] @ ee[m]) for m in a["r"] if m in b["r"])
                else:
                    own = (a["m"] @ works[j]) if "m" in a else (b["m"] @ works[i])
                info[i, j] = info[j, i] = own - works[i] @ inverse @ works[j]
        em = [(q[g] + t[g]) / self.design.groups[g].n for g in range(len(covs))]
        for block, r in enumerate(rs):
            own = [m for m, s in self.patterns.items() if s.block == block]
            em.append((ee[own[0]] + ss[own[0]]) / self.patterns[own[0]].n if len(own) == 1 else r)
        return Evaluation(theta, total, score, info, sol, inverse, self.vector(em))

class LevelInverse:
    """The inverse of the equations where it is needed: among what is not eliminated, between that and each level, and within each level."""

    def __init__(self, rest: np.ndarray, cross: np.ndarray, own: np.ndarray, places: np.ndarray, columns: np.ndarray) -> None:
        self.rest, self.cross, self.own = rest, cross, own
        size = len(places) + columns.size
        #: By column: the place in rest, or the level and the coefficient.
        self.place, self.level, self.at = np.full(size, -1), np.full(size, -1), np.zeros(size, np.int64)
        self.place[places] = np.arange(len(places))
        used = columns >= 0
        level, at = np.nonzero(used)
        self.level[columns[used]], self.at[columns[used]] = level, at
        self.size = size

    def diagonal(self) -> np.ndarray:
        every = np.arange(self.size)
        return self[every, every]

    def __getitem__(self, key: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Entries by row and column; those between two levels are not held: not a number."""
        i, j = (np.asarray(k) for k in key)
        a, b = self.level[i], self.level[j]
        within = np.where(a == b, self.own[a, self.at[i], self.at[j]], np.nan)
        low = self.cross[a, self.place[j], self.at[i]]
        high = self.cross[b, self.place[i], self.at[j]]
        flat = self.rest[self.place[i], self.place[j]]
        known = ((a >= 0) | (self.place[i] >= 0)) & ((b >= 0) | (self.place[j] >= 0))
        return np.where(known, np.where(a >= 0, np.where(b >= 0, within, low), np.where(b >= 0, high, flat)), 0.0)

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        i, j = np.meshgrid(np.arange(self.size), np.arange(self.size), indexing="ij")
        return self[i, j]


class LevelLikelihood(Likelihood):
    """The same where the levels of one group, independent of each other, never meet in a record.

    With them first, the equations are small blocks, one a level, and a border as wide as all other columns.
    Blocks are inverted each by itself and the border by what they leave of it: memory and time grow with the
    number of levels, not with its square.
    """

    def __init__(self, design: Design, patterns: dict[tuple, LevelStatistics], kinv: list[np.ndarray | None], absorbed: int) -> None:
        self.absorbed = absorbed
        super().__init__(design, patterns, kinv)
        group, width, t = design.groups[absorbed], design.width, self.traits
        self.inside = design.rest(absorbed)
        kept = np.zeros(t * width, bool)
        kept[self.kept] = True
        self.held = np.flatnonzero(kept.reshape(t, width)[:, self.inside].ravel())
        pairs = self.pairs[absorbed]
        self.of_trait, self.of_coefficient = [k for k, _ in pairs], [c for _, c in pairs]
        #: Numbers of the columns: of the border (traits x rest), and by level and coefficient.
        self.border = (np.arange(t)[:, None] * width + self.inside[None, :]).ravel()
        self.columns = np.stack([k * width + np.arange(group.columns(c).start, group.columns(c).stop) for k, c in pairs], 1)

    def _rest(self, g: int, a: int) -> slice:
        """The place in the border of a coefficient of another group."""
        group, (trait, c) = self.design.groups[g], self.pairs[g][a]
        at = trait * len(self.inside) + int(np.searchsorted(self.inside, group.columns(c).start))
        return slice(at, at + group.n)

    def _whole(self, rest: np.ndarray, levels: np.ndarray) -> np.ndarray:
        out = np.zeros(self.traits * self.design.width)
        out[self.border] = rest
        out[self.columns] = levels
        return out

    def _system(self, theta: np.ndarray) -> tuple:
        """Of the data: border, cross (levels, border, k), own (levels, k, k); right-hand sides; y'R^-1 y; the border with the other groups' precision, and the blocks' inverses and log determinant."""
        covs, rs = self.split(theta)
        t, q, n = self.traits, len(self.inside), self.design.groups[self.absorbed].n
        tr, co = self.of_trait, self.of_coefficient
        data, rhs, yy = np.zeros((t * q, t * q)), np.zeros(t * q), 0.0
        cross, own, side = np.zeros((n, t, q, len(tr))), np.zeros((n, len(tr), len(tr))), np.zeros((n, len(tr)))
        for m, s in self.patterns.items():
            ri = self._residual_inverse(rs[s.block], m)
            data += np.kron(ri, s.ww)
            rhs += (s.wy @ ri).T.ravel()
            yy += float((ri * s.yy).sum())
            for a, (k, c) in enumerate(zip(tr, co, strict=True)):
                for j in np.flatnonzero(ri[:, k]):
                    cross[:, j, :, a] += ri[j, k] * s.cross[:, :, c]
                for b, (l, d) in enumerate(zip(tr, co, strict=True)):
                    if ri[k, l]:
                        own[:, a, b] += ri[k, l] * s.own[:, c, d]
                side[:, a] += s.ly[:, c, :] @ ri[:, k]
        cross = cross.reshape(n, t * q, len(tr))
        full = data.copy()
        for g, cov in enumerate(covs):
            if g != self.absorbed:
                inv = np.linalg.inv(cov)
                for a in range(len(cov)):
                    for b in range(len(cov)):
                        full[self._rest(g, a), self._rest(g, b)] += inv[a, b] * self.kinv[g]
        blocks = own + np.linalg.inv(covs[self.absorbed])
        if len(tr) == 1:
            inverse, log = 1 / blocks, float(np.log(blocks).sum())
        else:
            inverse, log = np.linalg.inv(blocks), float(np.linalg.slogdet(blocks)[1].sum())
        return data, cross, own, rhs, side, yy, full, inverse, log

    def _reduced(self, theta: np.ndarray) -> tuple:
        """The system, the border that is left (of what is held), G = cross times the blocks' inverses, and the value."""
        data, cross, own, rhs, side, yy, full, inverse, log = system = self._system(theta)
        covs, rs = self.split(theta)
        held = self.held
        thin = cross[:, held, :]
        g = thin @ inverse
        left = full[np.ix_(held, held)] - np.tensordot(g, thin, ([0, 2], [0, 2]))
        right = rhs[held] - np.tensordot(g, side, ([0, 2], [0, 1]))
        sol = np.zeros(len(rhs))
        sol[held] = np.linalg.solve(left, right)
        u = np.einsum("nab,nb->na", inverse, side) - np.tensordot(g, sol[held], ([1], [0]))
        total = log + np.linalg.slogdet(left)[1] + yy - sol @ rhs - float((u * side).sum())
        for m, s in self.patterns.items():
            seen = np.flatnonzero(m[: self.traits])
            total += s.n * np.linalg.slogdet(rs[s.block][np.ix_(seen, seen)])[1]
        for k, cov in enumerate(covs):
            total += self.design.groups[k].n * np.linalg.slogdet(cov)[1] - len(cov) * self.log_kinv[k]
        return float(total), sol, u, left, g, system

    def _solve(self, theta: np.ndarray) -> tuple:
        return self._reduced(theta)

    def draw(self, theta: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        _, sol, u, left, g, system = self._reduced(theta)
        noise = np.linalg.solve(np.linalg.cholesky(left).T, rng.normal(size=len(self.held)))
        sol[self.held] += noise
        half = np.linalg.cholesky(system[7])
        u = u - np.tensordot(g, noise, ([1], [0])) + np.einsum("nab,nb->na", half, rng.normal(size=u.shape))
        return self._whole(sol, u)

    def squares(self, sol: np.ndarray) -> float:
        (s,) = self.patterns.values()
        b, u = sol[self.border], sol[self.columns]
        cross = np.einsum("nqc,q->nc", s.cross, b)
        return float(s.yy[0, 0] - 2 * (b @ s.wy[:, 0] + (u * s.ly[:, :, 0]).sum()) + b @ s.ww @ b + 2 * (u * cross).sum() + np.einsum("na,nab,nb->", u, s.own, u))

    def evaluate(self, theta: np.ndarray) -> Evaluation:
        covs, rs = self.split(theta)
        t, q, held, k_own = self.traits, len(self.inside), self.held, self.absorbed
        tr, co = self.of_trait, self.of_coefficient
        group, every = self.design.groups[k_own], range(len(self.of_trait))
        total, b, u, left, g, (data, cross, own, _, _, _, _, inverse, _) = self._reduced(theta)
        inner = np.linalg.inv(left)
        rest = np.zeros((t * q, t * q))
        rest[np.ix_(held, held)] = inner
        gi = np.tensordot(g, inner, ([1], [0])).transpose(0, 2, 1)  # levels, held, k
        between = np.zeros((len(g), t * q, len(tr)))
        between[:, held, :] = -gi
        blocks = inverse + np.einsum("nha,nhb->nab", g, gi)
        forms, t_of = [], []
        for n, cov in enumerate(covs):
            if n == k_own:
                forms.append(u.T @ u)
                t_of.append(blocks.sum(0))
            else:
                own_u = np.stack([b[self._rest(n, a)] for a in range(len(cov))], 1)
                forms.append(self.forms(n, own_u))
                t_of.append(np.array([[(self.kinv[n] * rest[self._rest(n, a), self._rest(n, c)]).sum() for c in range(len(cov))] for a in range(len(cov))]))
        by_trait = b.reshape(t, q)
        effects = np.zeros((group.n, group.dim, t))
        for a in every:
            effects[:, co[a], tr[a]] = u[:, a]
        ee, ss, we, ris = {}, {}, {}, {}
        for m, s in self.patterns.items():
            ris[m] = self._residual_inverse(rs[s.block], m)
            fit_rest = by_trait @ s.ww + np.tensordot(effects, s.cross, ([0, 1], [0, 2]))
            fit_levels = np.einsum("nqc,tq->nct", s.cross, by_trait) + np.einsum("ncd,ndt->nct", s.own, effects)
            products = by_trait @ s.wy + np.tensordot(effects, s.ly, ([0, 1], [0, 1]))
            ee[m] = s.yy - products - products.T + fit_rest @ by_trait.T + np.tensordot(fit_levels, effects, ([0, 1], [0, 1]))
            v = np.array([[(rest[i * q : (i + 1) * q, j * q : (j + 1) * q] * s.ww).sum() for j in range(t)] for i in range(t)])
            for a in every:
                side = np.array([(between[:, i * q : (i + 1) * q, a] * s.cross[:, :, co[a]]).sum() for i in range(t)])
                v[:, tr[a]] += side
                v[tr[a], :] += side
                for c in every:
                    v[tr[a], tr[c]] += (blocks[:, a, c] * s.own[:, co[a], co[c]]).sum()
            ss[m] = v
            we[m] = (s.wy - fit_rest.T, s.ly - fit_levels)
        score, works, kinds = np.zeros(len(theta)), [], []
        for k, p in enumerate(self.parameters):
            if p.group is not None:
                cov = covs[p.group]
                e = np.zeros_like(cov)
                e[p.a, p.b] = e[p.b, p.a] = 1
                inv = np.linalg.inv(cov)
                score[k] = self.design.groups[p.group].n * np.trace(inv @ e) - np.trace(inv @ e @ inv @ (forms[p.group] + t_of[p.group]))
                mix, m_rest, m_levels = e @ inv, np.zeros(t * q), np.zeros_like(u)
                if p.group == k_own:
                    m_levels = u @ mix.T
                else:
                    for a in range(len(cov)):
                        m_rest[self._rest(p.group, a)] = sum(mix[a, c] * b[self._rest(p.group, c)] for c in range(len(cov)))
                works.append((data @ m_rest + np.tensordot(cross, m_levels, ([0, 2], [0, 1])), np.tensordot(cross, m_rest, ([1], [0])) + np.einsum("nab,nb->na", own, m_levels)))
                kinds.append({"m": (m_rest, m_levels)})
            else:
                e = np.zeros((t, t))
                e[p.a, p.b] = e[p.b, p.a] = 1
                w_rest, w_levels, parts = np.zeros((t, q)), np.zeros_like(u), {}
                for m, s in self.patterns.items():
                    if s.block != p.block:
                        continue
                    ri = ris[m]
                    score[k] += s.n * np.trace(ri @ e) - np.trace(ri @ e @ ri @ (ee[m] + ss[m]))
                    parts[m] = ri @ e @ ri
                    w_rest += (we[m][0] @ parts[m]).T
                    w_levels += (we[m][1] @ parts[m])[:, co, tr]
                works.append((w_rest.ravel(), w_levels))
                kinds.append({"r": parts, "e": e})
        times = lambda x, y: float(x[0] @ y[0] + (x[1] * y[1]).sum())
        solved = []
        for r, l in works:
            x = np.zeros(t * q)
            x[held] = inner @ (r[held] - np.tensordot(g, l, ([0, 2], [0, 1])))
            solved.append((x, np.einsum("nab,nb->na", inverse, l) - np.tensordot(g, x[held], ([1], [0]))))
        info = np.zeros((len(theta), len(theta)))
        for i, a in enumerate(kinds):
            for j, c in enumerate(kinds[: i + 1]):
                if "m" in a:
                    shared = times(a["m"], works[j])
                elif "m" in c:
                    shared = times(c["m"], works[i])
                else:
                    shared = sum(np.trace(a["r"][m] @ c["e"] @ ris[m] @ ee[m]) for m in a["r"] if m in c["r"])
                info[i, j] = info[j, i] = shared - times(works[i], solved[j])
        em = [(forms[n] + t_of[n]) / self.design.groups[n].n for n in range(len(covs))]
        for block, r in enumerate(rs):
            seen = [m for m, s in self.patterns.items() if s.block == block]
            em.append((ee[seen[0]] + ss[seen[0]]) / self.patterns[seen[0]].n if len(seen) == 1 else r)
        return Evaluation(theta, total, score, info, self._whole(b, u), LevelInverse(rest, between, blocks, self.border, self._numbered()), self.vector(em))

    def _numbered(self) -> np.ndarray:
        """Levels x (traits x coefficients): the columns, -1 for those of coefficients that a trait does not have."""
        group, width = self.design.groups[self.absorbed], self.design.width
        out = np.full((group.n, self.traits * group.dim), -1)
        out[:, : self.columns.shape[1]] = self.columns
        return out


def likelihood(design: Design, kinv: list[np.ndarray | None]) -> Likelihood:
    """Of a design that has its sums of products; design.absorbed says which of the two."""
    return Likelihood(design, design.patterns, kinv) if design.absorbed is None else LevelLikelihood(design, design.patterns, kinv, design.absorbed)


@dataclass
class Walk:
    evaluation: Evaluation
    converged: bool
    iterations: int
    decrement: float
    relative_step: float
    trace: list[tuple[np.ndarray, float]]


def maximize(lik: Likelihood, start: np.ndarray | None = None, most: int = 300, tolerance: float = 1e-8, warm: int = 4) -> Walk:
    """AI-REML: a few EM steps, then damped Newton steps on the average information.

    A step that leaves the valid set or does not improve is damped more, then halved; if none helps, an EM
    step is taken. Converged means a relative step under the tolerance and a Newton decrement under 2e-4,
    components at their lower bound left aside. With most = 0 the start is evaluated, and never called converged.
    """
    theta = lik.start() if start is None else np.asarray(start, float)
    if not lik.valid(theta, 0.0):
        raise ValueError("the start is not positive definite")
    now = lik.evaluate(theta)
    trace, damp, relative, decrement, done, k = [(theta, now.neg2logl)], 1e-3, np.inf, np.inf, False, 0
    floor = 1e-10 * lik.spread()
    stalled = 0
    while k < most and not done and stalled < 25:
        k += 1
        candidate = None
        if k > warm:
            diagonal = np.array([p.a == p.b for p in lik.parameters])
            free = ~(diagonal & (now.theta < 1e3 * floor) & (now.score > 0))
            info = now.information[np.ix_(free, free)]
            values, vectors = np.linalg.eigh(info)
            safe = np.maximum(values, 1e-9 * max(values.max(), 1e-300))
            decrement = float(((vectors.T @ now.score[free]) ** 2 / safe).sum())
            for _ in range(12):
                step = np.zeros(len(theta))
                step[free] = -np.linalg.solve(vectors @ np.diag(safe) @ vectors.T + damp * np.diag(np.maximum(np.diag(info), 1e-300)), now.score[free])
                for part in (1.0, 0.5, 0.25):
                    new = now.theta + part * step
                    if lik.valid(new) and lik.value(new) <= now.neg2logl + 1e-9:
                        candidate = new
                        break
                if candidate is not None:
                    damp = max(damp / 10, 1e-10)
                    break
                damp *= 10
            if candidate is None and decrement < 2e-4:  # nothing better within rounding of the value
                relative, done = 0.0, True
                break
        if candidate is None:
            candidate = now.em if lik.valid(now.em) else now.theta
        relative = float(np.abs(candidate - now.theta).max() / max(np.abs(now.theta).max(), 1e-300))
        last, now = now.neg2logl, lik.evaluate(candidate)
        stalled = stalled + 1 if now.neg2logl > last - 1e-9 else 0
        trace.append((candidate, now.neg2logl))
        done = k > warm and relative < tolerance
    return Walk(now, bool(done and decrement < 2e-4), k, decrement, relative, trace)


def dense_neg2logl(y: np.ndarray, x: np.ndarray, v: np.ndarray) -> float:
    """The same value from the dense covariance matrix of the records: the independent route tests use."""
    vi = np.linalg.inv(v)
    xvx = x.T @ vi @ x
    b = np.linalg.solve(xvx, x.T @ vi @ y)
    e = y - x @ b
    return float(np.linalg.slogdet(v)[1] + np.linalg.slogdet(xvx)[1] + e @ vi @ e)
