"""Pedigrees: checks, founders, pruning, generations, inbreeding and the inverse relationship matrix.

A pedigree is a DataFrame (id, sire, dam) of labels, null for unknown, and optionally via_mgs: then `dam`
holds the maternal grandsire of that row. Joins by label do what is proportional to the data. The inbreeding
recursion is sequential: of few animals it runs on the driver, on three integer columns, and of many in tasks,
families that no pedigree line connects being independent of each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestock.functions.labels import is_unknown_animal
from lodestock.session import shuffled, written

#: Animals up to which a pedigree is held as arrays on the driver (three integers and a double each).
DRIVER_ANIMALS = 5_000_000
#: Animals up to which inbreeding() runs its recursion there; beyond that families are dealt to tasks, some so many animals each.
FAMILY_ANIMALS = 200_000
PART_ANIMALS = 50_000


def pedigree(df: DataFrame, id: str = "id", sire: str = "sire", dam: str = "dam") -> DataFrame:
    """(id, sire, dam) as labels, unknown codes as null; repeated or unknown animals and parents without a line are errors."""
    own = [F.col(c).cast("string") for c in (id, sire, dam)]
    ped = df.select(own[0].alias("id"), *[F.when(~is_unknown_animal(c), c).alias(n) for c, n in zip(own[1:], ("sire", "dam"), strict=True)])
    bad = ped.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | is_unknown_animal(F.col("id"))).limit(3).collect()
    if bad:
        raise ValueError(f"repeated or unknown animals: {[r.id for r in bad]}")
    lost = missing_parents(ped).limit(3).collect()
    if lost:
        raise ValueError(f"parents without a line of their own: {[r.id for r in lost]}")
    return ped


def parents_of(ped: DataFrame) -> DataFrame:
    """(id, parent): one row a known parent."""
    return ped.select("id", F.explode(F.array("sire", "dam")).alias("parent")).filter("parent is not null")


def missing_parents(ped: DataFrame) -> DataFrame:
    return parents_of(ped).select(F.col("parent").alias("id")).distinct().join(ped.select("id"), "id", "left_anti")


def sire_mgs(df: DataFrame, id: str = "id", sire: str = "sire", mgs: str = "mgs", dam: str | None = None) -> DataFrame:
    """A pedigree by maternal grandsires. With a dam column, a row with a known dam keeps it and its grandsire is checked against the dam's sire."""
    cols = [F.col(id).cast("string").alias("id"), F.col(sire).cast("string").alias("sire"), F.col(mgs).cast("string").alias("mgs"), (F.col(dam) if dam else F.lit(None)).cast("string").alias("dam")]
    rows = df.select(*cols)
    rows = rows.select("id", *[F.when(~is_unknown_animal(F.col(c)), F.col(c)).alias(c) for c in ("sire", "mgs", "dam")])
    if dam:
        known = rows.filter("dam is not null and mgs is not null").join(rows.select(F.col("id").alias("dam"), F.col("sire").alias("_s")), "dam")
        if clash := known.filter("_s is not null and _s <> mgs").limit(3).collect():
            raise ValueError(f"the dam's sire is not the grandsire: {[r.id for r in clash]}")
    return rows.select("id", "sire", F.coalesce("dam", "mgs").alias("dam"), (F.col("dam").isNull() & F.col("mgs").isNotNull()).alias("via_mgs"))


def with_founders(ped: DataFrame, ids: DataFrame) -> DataFrame:
    """ped and a founder's line for each id (column id) that has none; unknown codes are none."""
    wanted = ids.select(F.col("id").cast("string").alias("id")).filter(~is_unknown_animal(F.col("id"))).distinct()
    new = wanted.join(ped.select("id"), "id", "left_anti")
    return ped.unionByName(new.select("id", F.lit(None).cast("string").alias("sire"), F.lit(None).cast("string").alias("dam")), allowMissingColumns=True)


def pruned(ped: DataFrame, ids: DataFrame) -> DataFrame:
    """The lines of ids (column id) and of all their ancestors. One join a generation; each frontier is a written table."""
    links = parents_of(ped)
    known = written(ids.select(F.col("id").cast("string").alias("id")).distinct(), "kept")
    frontier = known
    while True:
        frontier = written(links.join(shuffled(frontier), "id").select(F.col("parent").alias("id")).distinct().join(shuffled(known), "id", "left_anti"), "frontier")
        if frontier.isEmpty():
            return ped.join(shuffled(known), "id", "left_semi")
        known = written(known.unionByName(frontier), "kept")


def generations(ped: DataFrame) -> DataFrame:
    """ped with gen: 0 for founders, else one more than the latest parent's. A cycle is an error."""
    known = written(ped.filter("sire is null and dam is null").select("id", F.lit(0).alias("gen")), "generation")
    open_rows = ped.filter("sire is not null or dam is not null")
    while not open_rows.isEmpty():
        parent = lambda c: known.select(F.col("id").alias(c), F.col("gen").alias(f"_{c}"))
        tried = open_rows.join(parent("sire"), "sire", "left").join(parent("dam"), "dam", "left")
        ready = ((F.col("sire").isNull()) | F.col("_sire").isNotNull()) & ((F.col("dam").isNull()) | F.col("_dam").isNotNull())
        tried = written(tried.withColumn("_ready", ready), "generation")
        done = tried.filter("_ready").select("id", (F.greatest(F.coalesce("_sire", F.lit(-1)), F.coalesce("_dam", F.lit(-1))) + 1).alias("gen"))
        if done.isEmpty():
            raise ValueError("the pedigree has a cycle")
        known = written(known.unionByName(done), "generation")
        open_rows = tried.filter(~F.col("_ready")).select(*ped.columns)
    return ped.join(known, "id")


def blocks(ped: DataFrame) -> DataFrame:
    """(id, block): animals connected by known parents; a block is named by its smallest id."""
    return connected(ped.select("id"), parents_of(ped))


def connected(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, block) of ids (column id) that links (id, parent) connect; a block is named by its smallest id."""
    links = written(links.unionByName(links.select(F.col("parent").alias("id"), F.col("id").alias("parent"))).distinct(), "links")
    labels = written(ids.select("id", F.col("id").alias("block")), "blocks")
    while True:
        near = links.join(shuffled(labels.withColumnRenamed("id", "parent")), "parent").groupBy("id").agg(F.min("block").alias("_near"))
        new = labels.join(shuffled(near), "id", "left").select("id", "block", F.least("block", F.coalesce("_near", "block")).alias("_new"))
        # a label's own label is as good: chains halve
        up = new.select(F.col("id").alias("_new"), F.col("_new").alias("_up"))
        new = written(new.join(shuffled(up), "_new", "left").select("id", "block", F.least("_new", F.coalesce("_up", "_new")).alias("_new")), "blocks")
        if new.filter("block <> _new").isEmpty():
            return new.select("id", "block")
        labels = new.select("id", F.col("_new").alias("block"))


def mendelian_variance(sire_f: Column, dam_f: Column, via_mgs: Column) -> Column:
    """Within-family variance from the parents' inbreeding (null: parent unknown), of a row by sire and dam or by sire and maternal grandsire."""
    by_dam = F.when(sire_f.isNotNull() & dam_f.isNotNull(), F.lit(0.5) - (sire_f + dam_f) / 4).when(sire_f.isNull() & dam_f.isNull(), F.lit(1.0)).otherwise(F.lit(0.75) - F.coalesce(sire_f, dam_f) / 4)
    by_mgs = F.when(sire_f.isNotNull() & dam_f.isNotNull(), F.lit(11 / 16) - sire_f / 4 - dam_f / 16).when(sire_f.isNotNull(), F.lit(0.75) - sire_f / 4).when(dam_f.isNotNull(), F.lit(15 / 16) - dam_f / 16).otherwise(F.lit(1.0))
    return F.when(via_mgs, by_mgs).otherwise(by_dam)


def _sequence(sire: np.ndarray, dam: np.ndarray) -> np.ndarray:
    """An order with parents before offspring, of parents by index (-1 unknown)."""
    n = len(sire)
    gen = np.zeros(n, np.int64)
    for _ in range(n + 1):
        new = np.maximum(np.where(sire >= 0, gen[sire] + 1, 0), np.where(dam >= 0, gen[dam] + 1, 0))
        if (new == gen).all():
            return np.argsort(gen, kind="stable")
        if new.max() >= n:
            break
        gen = new
    raise ValueError("the pedigree has a cycle")


def inbreeding_of(sire: np.ndarray, dam: np.ndarray, share: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(F, Mendelian variance) of animals whose parents (index, -1 unknown) come before them. share: what comes by the second parent, 1/2 or 1/4.

    Each animal's relationship with itself is the sum over its ancestors of (share of genes)^2 times
    their Mendelian variance; ancestors are visited from the youngest, each once.
    """
    import heapq

    n = len(sire)
    share = np.full(n, 0.5) if share is None else share
    f, d = np.zeros(n), np.ones(n)
    s_of, d_of, w_of = sire.tolist(), dam.tolist(), share.tolist()
    done: dict[tuple[int, int, float], float] = {}
    for i in range(n):
        s, k, w = s_of[i], d_of[i], w_of[i]
        f_s, f_k = (f[s] if s >= 0 else -1.0), (f[k] if k >= 0 else -1.0)
        d[i] = 1 - 0.25 * (1 + f_s) - w * w * (1 + f_k)
        if s < 0 or k < 0:
            continue
        if (s, k, w) in done:  # full sibs
            f[i] = done[s, k, w]
            continue
        genes, heap, total = {i: 1.0}, [-i], 0.0
        while heap:
            j = -heapq.heappop(heap)
            g = genes.pop(j)
            total += g * g * d[j]
            for p, part in ((s_of[j], 0.5), (d_of[j], w_of[j])):
                if p >= 0:
                    if p not in genes:
                        genes[p] = 0.0
                        heapq.heappush(heap, -p)
                    genes[p] += g * part
        f[i] = done[s, k, w] = 0.0 if -1e-10 < total - 1 < 0 else total - 1
    return f, d


class Family:
    """A pedigree as arrays in an order with parents first: ids, sire, dam (index or -1), share, f, d."""

    def __init__(self, ped: DataFrame | pa.Table) -> None:
        if isinstance(ped, pa.Table):
            rows, n = ped.sort_by("id"), ped.num_rows
        else:
            n = ped.count()
            if n > DRIVER_ANIMALS:
                raise ValueError(f"{n} animals: prune the pedigree to those with data and their ancestors")
            has = "via_mgs" in ped.columns
            rows = ped.select("id", "sire", "dam", (F.coalesce("via_mgs", F.lit(False)) if has else F.lit(False)).alias("via")).orderBy("id").toArrow()
        ids = rows["id"].to_pylist()
        place = {a: k for k, a in enumerate(ids)}
        sire, dam = (np.array([place.get(p, -1) for p in rows[c].to_pylist()], np.int64) for c in ("sire", "dam"))
        order = _sequence(sire, dam)
        back = np.empty(n + 1, np.int64)
        back[order], back[n] = np.arange(n), -1
        self.ids = [ids[k] for k in order.tolist()]
        self.sire, self.dam = back[sire[order]], back[dam[order]]
        self.share = np.where(np.asarray(rows["via"].to_pylist(), bool)[order], 0.25, 0.5) if n else np.zeros(0)
        self.f, self.d = inbreeding_of(self.sire, self.dam, self.share)
        self.place = {a: k for k, a in enumerate(self.ids)}

    def __len__(self) -> int:
        return len(self.ids)

    def times(self, v: np.ndarray) -> np.ndarray:
        """A v for a vector or the columns of a matrix, without A: down the pedigree, times d, and up again."""
        z = np.array(v, float)
        for i in range(len(self) - 1, -1, -1):
            for p, w in ((self.sire[i], 0.5), (self.dam[i], self.share[i])):
                if p >= 0:
                    z[p] += w * z[i]
        z *= self.d if z.ndim == 1 else self.d[:, None]
        for i in range(len(self)):
            for p, w in ((self.sire[i], 0.5), (self.dam[i], self.share[i])):
                if p >= 0:
                    z[i] += w * z[p]
        return z

    def _generations(self) -> list[np.ndarray]:
        """Places of the animals by generation, the latest parent's and one."""
        if not hasattr(self, "_by_generation"):
            gen = np.zeros(len(self), np.int64)
            while True:
                new = np.maximum(np.where(self.sire >= 0, gen[self.sire] + 1, 0), np.where(self.dam >= 0, gen[self.dam] + 1, 0))
                if (new == gen).all():
                    break
                gen = new
            order = np.argsort(gen, kind="stable")
            self._by_generation = np.split(order, np.cumsum(np.bincount(gen))[:-1]) if len(self) else []
        return self._by_generation

    def from_parents(self, v: np.ndarray, share: np.ndarray | None = None) -> np.ndarray:
        """T v: each animal's own row and its parents' parts of theirs, a generation at a time."""
        z, share = np.array(v, float), self.share if share is None else share
        for at in self._generations():
            for p, w in ((self.sire[at], np.full(len(at), 0.5)), (self.dam[at], share[at])):
                has = p >= 0
                z[at[has]] += (w[has] if z.ndim == 1 else w[has, None]) * z[p[has]]
        return z

    def down(self, v: np.ndarray) -> np.ndarray:
        """T' v, a generation at a time from the youngest."""
        z = np.array(v, float)
        for at in self._generations()[::-1]:
            for p, w in ((self.sire[at], np.full(len(at), 0.5)), (self.dam[at], self.share[at])):
                has = p >= 0
                np.add.at(z, p[has], (w[has] if z.ndim == 1 else w[has, None]) * z[at[has]])
        return z

    def less_parents(self, v: np.ndarray, share: np.ndarray | None = None) -> np.ndarray:
        """T^-1 v: each row less its parents' parts."""
        z, share = np.array(v, float), self.share if share is None else share
        for p, w in ((self.sire, np.full(len(self), 0.5)), (self.dam, share)):
            has = np.flatnonzero(p >= 0)
            z[has] -= (w[has] if z.ndim == 1 else w[has, None]) * v[p[has]]
        return z

    def to_parents(self, v: np.ndarray, share: np.ndarray | None = None) -> np.ndarray:
        """T'^-1 v: each row less its parts in the offspring's."""
        z, share = np.array(v, float), self.share if share is None else share
        for p, w in ((self.sire, np.full(len(self), 0.5)), (self.dam, share)):
            has = np.flatnonzero(p >= 0)
            np.add.at(z, p[has], -(w[has] if z.ndim == 1 else w[has, None]) * v[has])
        return z

    def inverse_times(self, v: np.ndarray) -> np.ndarray:
        """A^-1 v without A^-1."""
        z = self.less_parents(v)
        return self.to_parents(z / (self.d if z.ndim == 1 else self.d[:, None]))

    def inverse_entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, x): one triangle (i >= j) of A^-1, each entry once."""
        n = len(self)
        every = np.arange(n)
        parts = [(every, np.ones(n)), (self.sire, np.full(n, -0.5)), (self.dam, -self.share)]
        rows, cols, values = [], [], []
        for a, (p, u) in enumerate(parts):
            for q, w in parts[: a + 1]:
                has = np.flatnonzero((p >= 0) & (q >= 0))
                twice = np.where((p is not q) & (p[has] == q[has]), 2.0, 1.0)  # a parent that stands twice
                rows.append(np.maximum(p[has], q[has]))
                cols.append(np.minimum(p[has], q[has]))
                values.append(twice * u[has] * w[has] / self.d[has])
        key, where = np.unique(np.concatenate(rows) * n + np.concatenate(cols), return_inverse=True)
        return key // n, key % n, np.bincount(where, np.concatenate(values), len(key))

    def relationship(self, ids: list[str]) -> np.ndarray:
        """The relationship matrix of some animals, one column of A at a time."""
        own = [self.place[a] for a in ids]
        unit = np.zeros((len(self), len(own)))
        unit[own, np.arange(len(own))] = 1
        return self.times(unit)[own]

    def inverse(self) -> np.ndarray:
        """The inverse of A as a dense matrix."""
        out = np.zeros((len(self), len(self)))
        for i in range(len(self)):
            v = {i: 1.0}
            for p, w in ((self.sire[i], 0.5), (self.dam[i], self.share[i])):
                if p >= 0:
                    v[p] = v.get(p, 0.0) - w
            at, c = list(v), np.array(list(v.values()))
            out[np.ix_(at, at)] += np.outer(c, c) / self.d[i]
        return out


def inbreeding(ped: DataFrame) -> DataFrame:
    """(id, f, d): inbreeding and Mendelian variance of every animal.

    Only animals with two known parents can be inbred, so of many animals these and their ancestors are what
    the recursion is for. They are dealt to tasks by family (connected()); d follows by two joins. One family is
    one task, which holds it as arrays.
    """
    if ped.count() <= FAMILY_ANIMALS:
        fam = Family(ped)
        return ped.sparkSession.createDataFrame(pa.table({"id": pa.array(fam.ids, pa.string()), "f": fam.f, "d": fam.d}))
    via = "via_mgs" if "via_mgs" in ped.columns else None
    both = written(ped.filter("sire is not null and dam is not null").select("id"), "crossed")
    lines = ped.select("id", "sire", "dam", (F.coalesce(via, F.lit(False)) if via else F.lit(False)).alias("via"))
    known = _by_family(lines, both)
    parent = lambda c: known.select(F.col("id").alias(c), F.col("f").alias(f"_{c}"))
    out = lines.join(shuffled(known), "id").join(shuffled(parent("sire")), "sire", "left").join(shuffled(parent("dam")), "dam", "left")
    return out.select("id", "f", mendelian_variance(F.col("_sire"), F.col("_dam"), F.col("via")).alias("d"))


def _by_family(lines: DataFrame, both: DataFrame) -> DataFrame:
    """(id, f) of all lines."""
    own = written(pruned(lines, both), "lines")
    rest = written(lines.join(shuffled(own.select("id")), "id", "left_anti").select("id", F.coalesce("sire", "dam").alias("up")), "lines")
    _no_cycle(rest.filter("up is not null"))
    zero = rest.select("id", F.lit(0.0).alias("f"))
    n = own.count()
    if not n:
        return zero
    parts = -(-n // PART_ANIMALS)
    dealt = own.join(shuffled(connected(own.select("id"), parents_of(own))), "id").withColumn("_p", F.pmod(F.xxhash64("block"), F.lit(parts)))

    def recursion(table: pa.Table) -> pa.Table:
        fam = Family(table)
        return pa.table({"id": pa.array(fam.ids, pa.string()), "f": fam.f})

    found = dealt.select("id", "sire", "dam", "via", "_p").groupBy("_p").applyInArrow(recursion, "id string, f double")
    return written(found.unionByName(zero), "inbreeding")


def _no_cycle(links: DataFrame) -> None:
    """An error if lines of one known parent (id, up) lead back to themselves: links are joined end to end, twice as long each time, until none is left."""
    n, rounds = links.count(), 0
    while n and not links.isEmpty():
        if rounds > n.bit_length():
            raise ValueError("the pedigree has a cycle")
        links, rounds = written(links.join(shuffled(links.select(F.col("id").alias("up"), F.col("up").alias("_up"))), "up").select("id", F.col("_up").alias("up")), "links"), rounds + 1


def a_inverse(ped: DataFrame, variances: DataFrame | None = None) -> DataFrame:
    """(i, j, x) with i >= j as text: one triangle of the inverse relationship matrix.

    Each animal adds c c' / d for c = 1, -1/2 (sire), -1/2 (dam) or -1/4 (maternal grandsire), the
    coefficients of a parent that stands twice being added up first. An explode, a join-free pairing of
    the few coefficients, and one sum.

    variances: (id, d); by default the pedigree's own recursion is run.
    """
    d = (inbreeding(ped) if variances is None else variances).select("id", "d")
    share = F.when(F.col("via_mgs"), F.lit(-0.25)).otherwise(F.lit(-0.5)) if "via_mgs" in ped.columns else F.lit(-0.5)
    rows = ped.join(shuffled(d), "id").withColumn("_w", share)
    same = F.col("sire").eqNullSafe(F.col("dam")) & F.col("sire").isNotNull()
    entry = lambda who, c: F.struct(who.alias("k"), c.cast("double").alias("c"))
    first = entry(F.col("sire"), F.when(same, F.col("_w") - 0.5).otherwise(F.lit(-0.5)))
    second = entry(F.when(~same, F.col("dam")), F.col("_w"))
    parts = F.filter(F.array(entry(F.col("id"), F.lit(1.0)), first, second), lambda e: e["k"].isNotNull())
    pairs = F.flatten(F.transform(parts, lambda a: F.transform(F.filter(parts, lambda b: b["k"] <= a["k"]), lambda b: F.struct(a["k"].alias("i"), b["k"].alias("j"), (a["c"] * b["c"]).alias("x")))))
    return rows.select("d", F.inline(pairs)).groupBy("i", "j").agg(F.sum(F.col("x") / F.col("d")).alias("x"))


def a22_inverse(ped: DataFrame, ids: list[str]) -> np.ndarray:
    """The inverse of the relationship matrix of some animals (not a block of the inverse of A)."""
    return np.linalg.inv(Family(ped).relationship(ids))


def gene_fractions(ped: DataFrame, founders: DataFrame) -> DataFrame:
    """(id, group, q): shares of genes by founder group. founders: (id, group) of base animals. One join a generation."""
    known = written(generations(ped), "generation")
    last = known.agg(F.max("gen")).first()[0]
    q = written(founders.join(known.filter("gen = 0"), "id").select("id", "group", F.lit(1.0).alias("q")), "fractions")
    for g in range(1, (last or 0) + 1):
        new = parents_of(known.filter(F.col("gen") == g)).join(q.withColumnRenamed("id", "parent"), "parent").groupBy("id", "group").agg((F.sum("q") / 2).alias("q"))
        q = written(q.unionByName(new), "fractions")
    return q


def metafounder_relationship(fam: Family, group: dict[str, int], gamma: np.ndarray) -> np.ndarray:
    """A over animals whose unknown parents are groups with relationship gamma: the tabular recursion on a dense matrix.

    group: the group of each founder. Both parents of a founder are its group, so its own value is 1 + gamma/2.
    """
    q, n = len(gamma), len(fam)
    a = np.zeros((q + n, q + n))
    a[:q, :q] = gamma
    for i in range(n):
        base = q + i
        own = group.get(fam.ids[i], 0)
        s = q + fam.sire[i] if fam.sire[i] >= 0 else own
        k = q + fam.dam[i] if fam.dam[i] >= 0 else own
        a[base, :base] = a[:base, base] = (a[s, :base] + a[k, :base]) / 2
        a[base, base] = 1 + a[s, k] / 2
    return a[q:, q:]


def metafounder_variances(fam: Family, group: np.ndarray, fractions: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """Mendelian variances of metafounder_relationship() without its matrix. group: of each animal's unknown parents; fractions: of genes by group. The recursion is that of inbreeding_of, with what founders share by their groups."""
    import heapq

    n = len(fam)
    s, k = fam.sire, fam.dam
    shared = lambda p, own: np.where(p >= 0, np.einsum("ij,ij->i", fractions[p], gamma[own]), gamma[own, own])
    both = (s >= 0) & (k >= 0)
    # of one known parent, the relationship of that with the group; of none, the group's own
    between = np.where(s >= 0, shared(s, group), shared(k, group))
    own = np.where(both, 0.0, 1 + between / 2)  # diagonal
    of = lambda p, i: own[p] if p >= 0 else gamma[group[i], group[i]]
    d, done = np.zeros(n), {}
    if not both.any():
        at = lambda p: np.where(p >= 0, own[p], gamma[group, group])
        return 1 - (at(s) + at(k)) / 4
    s_of, k_of = s.tolist(), k.tolist()
    for i in range(n):
        d[i] = 1 - (of(s_of[i], i) + of(k_of[i], i)) / 4
        if not both[i]:
            continue
        pair = (s_of[i], k_of[i])
        if pair not in done:
            genes, heap, total = {i: 1.0}, [-i], float(fractions[i] @ gamma @ fractions[i])
            while heap:
                j = -heapq.heappop(heap)
                g = genes.pop(j)
                total += g * g * d[j]
                for p in (s_of[j], k_of[j]):
                    if p >= 0:
                        if p not in genes:
                            genes[p] = 0.0
                            heapq.heappush(heap, -p)
                        genes[p] += g / 2
            done[pair] = total
        own[i] = done[pair]
    return d
