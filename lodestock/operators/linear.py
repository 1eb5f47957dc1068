"""Linear algebra that fits hang on: sparse symmetric triplets, factors, selected inverses, and conjugate gradients on DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestock.session import shuffled, written

#: Entries of a matrix up to which it is multiplied on the driver (some tens of bytes each).
DRIVER_ENTRIES = 5_000_000
#: Entries up to which a sparse matrix is factored on the driver (dictionaries, some hundred bytes each), and of a part that a task factors.
FACTOR_ENTRIES = 200_000
PART_ENTRIES = 100_000
#: Rows up to which a block of a matrix is factored in one task, and of a border that joins blocks.
BLOCK_ROWS = 20_000
BORDER_ROWS = 50


def one_triangle(triplets: DataFrame) -> None:
    """Both triangles of a symmetric matrix would count its entries twice: an error."""
    sides = triplets.agg(F.count_if(F.col("i") > F.col("j")).alias("low"), F.count_if(F.col("i") < F.col("j")).alias("high")).first()
    if sides.low and sides.high:
        raise ValueError("give one triangle only")


@dataclass
class SparseFactor:
    """L L' of a permuted sparse symmetric matrix: rows of L by column (dicts), the order, and log determinant."""

    columns: list[dict[int, float]]
    order: list[int]
    logdet: float

    def solve(self, b: np.ndarray) -> np.ndarray:
        x = np.asarray(b, float)[self.order].copy()
        for k, col in enumerate(self.columns):
            x[k] /= col[k]
            for i, v in col.items():
                if i != k:
                    x[i] -= v * x[k]
        for k in range(len(self.columns) - 1, -1, -1):
            col = self.columns[k]
            x[k] = (x[k] - sum(v * x[i] for i, v in col.items() if i != k)) / col[k]
        out = np.empty_like(x)
        out[self.order] = x
        return out

    def selected_inverse(self) -> dict[tuple[int, int], float]:
        """Entries of the inverse in the pattern of the factor, in the matrix's own numbering (i >= j); others are unknown, not zero."""
        n, z = len(self.columns), {}
        get = lambda i, j: z.get((max(i, j), min(i, j)), 0.0)
        for k in range(n - 1, -1, -1):
            col, d = self.columns[k], self.columns[k][k]
            below = sorted((i for i in col if i != k), reverse=True)
            for i in below:
                z[i, k] = -sum(col[m] / d * get(m, i) for m in below)
            z[k, k] = 1 / (d * d) - sum(col[m] / d * z[m, k] for m in below)
        own = self.order
        return {(max(own[i], own[j]), min(own[i], own[j])): v for (i, j), v in z.items()}


def sparse_cholesky(n: int, entries: dict[tuple[int, int], float], reorder: bool = True) -> SparseFactor:
    """Right-looking factorisation on dictionaries, eliminating a node of least degree first."""
    rows: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), v in entries.items():
        rows[i][j] = v
        rows[j][i] = v
    left, order, columns, logdet = set(range(n)), [], [], 0.0
    import heapq

    heap = [(len(rows[k]), k) for k in range(n)] if reorder else []
    heapq.heapify(heap)
    natural = iter(range(n))
    while left:
        if reorder:
            degree, k = heapq.heappop(heap)
            if k not in left or degree != len(rows[k]):
                continue
        else:
            k = next(natural)
        pivot = rows[k].pop(k, 0.0)
        if not pivot > 0:
            raise ValueError("the matrix is not positive definite")
        d = pivot**0.5
        col = {i: v / d for i, v in rows[k].items()}
        for i in col:
            del rows[i][k]
        items = list(col.items())
        for a, (i, u) in enumerate(items):
            for j, v in items[a:]:
                rows[i][j] = rows[i].get(j, 0.0) - u * v
                if i != j:
                    rows[j][i] = rows[i][j]
        if reorder:
            for i in col:
                heapq.heappush(heap, (len(rows[i]), i))
        order.append(k)
        columns.append(col | {k: d})
        logdet += 2 * np.log(d)
        left.discard(k)
    place = {k: at for at, k in enumerate(order)}
    return SparseFactor([{place[i]: v for i, v in col.items()} for col in columns], order, logdet)


def collect_triplets(triplets: DataFrame, most: int = 5_000_000) -> tuple[list, dict[tuple[int, int], float]]:
    """Labels and entries of a triplet table on the driver, if it is small enough."""
    one_triangle(triplets)
    rows = triplets.select("i", "j", "x").limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise ValueError("too many entries for a direct factor: use conjugate gradients")
    return named_entries(rows)


def named_entries(rows: pa.Table) -> tuple[list, dict[tuple[int, int], float]]:
    """Labels, in order, and entries by their places."""
    a, b = rows["i"].to_pylist(), rows["j"].to_pylist()
    names = sorted({*a, *b})
    place = {x: k for k, x in enumerate(names)}
    return names, {(max(place[i], place[j]), min(place[i], place[j])): x for i, j, x in zip(a, b, rows["x"].to_pylist(), strict=True)}


def sparse_solve(triplets: DataFrame, b: DataFrame) -> DataFrame:
    """(i, x) of A x = b for one triangle of A (i, j, x) and b (i, b)."""
    names, entries = collect_triplets(triplets)
    right = {r.i: r.b for r in b.collect()}
    x = sparse_cholesky(len(names), entries).solve(np.array([right.get(n, 0.0) for n in names]))
    return triplets.sparkSession.createDataFrame(list(zip(names, x.tolist(), strict=True)), triplets.select(F.col("i"), F.col("x")).schema)


def selected_inverse(triplets: DataFrame, here: int = FACTOR_ENTRIES) -> DataFrame:
    """(i, j, x): the inverse's entries in the pattern of the factor.

    A matrix of over `here` entries is dealt to tasks by the blocks that its entries connect, which have their
    inverses each by itself; the order of elimination within a block is the same. One block is one task.
    """
    triplets = written(triplets.select("i", "j", "x"), "triplets")
    schema = triplets.schema
    if triplets.count() <= here:
        names, entries = collect_triplets(triplets)
        found = sparse_cholesky(len(names), entries).selected_inverse()
        return triplets.sparkSession.createDataFrame([(names[i], names[j], v) for (i, j), v in found.items()], schema)

    def invert(table: pa.Table) -> pa.Table:
        names, entries = named_entries(table)
        found = sparse_cholesky(len(names), entries).selected_inverse()
        i, j = np.array([*found], np.int64).reshape(-1, 2).T
        own = pa.array(names, table["i"].type)
        return pa.table({"i": own.take(pa.array(i)), "j": own.take(pa.array(j)), "x": pa.array([*found.values()], pa.float64())})

    return by_block(triplets).groupBy("_p").applyInArrow(invert, schema)


def by_block(triplets: DataFrame) -> DataFrame:
    """(i, j, x, _p): one triangle, its blocks (what entries connect) dealt to parts of some PART_ENTRIES; a block is in one part."""
    one_triangle(triplets)
    parts = max(1, -(-triplets.count() // PART_ENTRIES))
    return triplets.join(shuffled(blocks_of(triplets).select(F.col("id").alias("i"), F.pmod(F.xxhash64("block"), F.lit(parts)).alias("_p"))), "i").select("i", "j", "x", "_p")


def blocks_of(triplets: DataFrame) -> DataFrame:
    """(id, block) of the rows of a symmetric matrix that its entries connect."""
    from lodestock.operators.pedigree import connected

    off = triplets.filter("i <> j")
    ids = triplets.select(F.col("i").alias("id")).unionByName(off.select(F.col("j").alias("id"))).distinct()
    return connected(ids, off.select(F.col("i").alias("id"), F.col("j").alias("parent")))


def bordered_solve(triplets: DataFrame, b: DataFrame, border: list[str]) -> DataFrame | None:
    """(i, x) of A x = b where A without the rows of `border` falls into blocks of BLOCK_ROWS at most; none if it does not.

    Tasks factor the blocks, and solve them for b and for the columns of the border; what is left of the border
    is a small dense system, on the driver. triplets: one triangle (i, j, x) with labels; b: (i, b).
    """
    inside = lambda c: ~F.col(c).isin(border)
    own = triplets.filter(inside("i") & inside("j"))
    block = written(blocks_of(own), "blocks")
    if (block.groupBy("block").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > BLOCK_ROWS:
        return None
    turned = triplets.select(F.when(inside("i"), F.col("i")).otherwise(F.col("j")).alias("i"), F.when(inside("i"), F.col("j")).otherwise(F.col("i")).alias("j"), "x")
    rows = turned.filter(inside("i")).unionByName(b.filter(inside("i")).select("i", F.lit(None).cast("string").alias("j"), F.col("b").alias("x")))
    parts = max(1, -(-triplets.count() // PART_ENTRIES))
    rows = rows.join(shuffled(block.select(F.col("id").alias("i"), F.pmod(F.xxhash64("block"), F.lit(parts)).alias("_p"))), "i")
    at, p = {n: 1 + k for k, n in enumerate(border)}, len(border)

    def solve(table: pa.Table) -> pa.Table:
        j = table["j"].combine_chunks()
        side = np.asarray(pc.fill_null(pc.index_in(j, pa.array(border, pa.string())), -1))
        side = np.where(np.asarray(pc.is_null(j)), 0, np.where(side >= 0, side + 1, -1))
        names, entries = named_entries(table.filter(pa.array(side < 0)))
        right = np.zeros((len(names), 1 + p))
        of = np.asarray(pc.index_in(table["i"].combine_chunks(), pa.array(names, pa.string())))
        np.add.at(right, (of[side >= 0], side[side >= 0]), np.asarray(table["x"])[side >= 0])
        found = sparse_cholesky(len(names), entries).solve(right)
        sums = (right[:, 1:].T @ found).ravel()
        return pa.table({"i": pa.array([*names, None], pa.string()), "v": pa.array([*found.tolist(), sums.tolist()], pa.list_(pa.float64()))})

    found = written(rows.select("i", "j", "x", "_p").groupBy("_p").applyInArrow(solve, "i string, v array<double>"), "blocks")
    left, right = np.zeros((p, p)), np.zeros(p)
    for r in triplets.filter(~inside("i") & ~inside("j")).collect():
        left[at[r.i] - 1, at[r.j] - 1] = left[at[r.j] - 1, at[r.i] - 1] = r.x
    for r in b.filter(~inside("i")).collect():
        right[at[r.i] - 1] = r.b
    less = found.filter("i is null").select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("x")).collect()
    sums = np.zeros(p * (1 + p))
    for r in less:
        sums[r.pos] = r.x
    sums = sums.reshape(p, 1 + p)
    beta = np.linalg.solve(left - sums[:, 1:], right - sums[:, 0])
    x = F.col("v")[0]
    for k, v in enumerate(beta.tolist()):
        x = x - F.col("v")[k + 1] * v
    top = triplets.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(border, beta, strict=True)], "i string, x double")
    return found.filter("i is not null").select("i", x.alias("x")).unionByName(top)


def inv_pd(m: np.ndarray) -> np.ndarray:
    """The inverse of a positive definite matrix, by its Cholesky factor."""
    half = np.linalg.inv(np.linalg.cholesky(m))
    return half.T @ half


def conjugate_gradients(triplets: DataFrame, b: DataFrame, tolerance: float = 1e-8, most: int = 2000, here: int = DRIVER_ENTRIES) -> tuple[DataFrame, int, float]:
    """((i, x), iterations, relative residual) of A x = b, preconditioned by the diagonal.

    triplets: one triangle (i, j, x); b: (i, b). A matrix of up to `here` entries is multiplied by NumPy on
    the driver; a larger one and its vectors stay distributed.
    """
    one_triangle(triplets)
    few = triplets.select("i", "j", "x").limit(here + 1).toArrow()
    return _gradients_here(triplets, few, b, tolerance, most) if few.num_rows <= here else _gradients_there(triplets, b, tolerance, most)


def _gradients_here(triplets: DataFrame, table: pa.Table, b: DataFrame, tolerance: float, most: int) -> tuple[DataFrame, int, float]:
    i, j, x = (table[c].combine_chunks() for c in ("i", "j", "x"))
    names = pc.unique(pa.chunked_array([i, j]))
    i, j, x = np.asarray(pc.index_in(i, names)), np.asarray(pc.index_in(j, names)), np.asarray(x)
    off = i != j
    row, col, value = np.r_[i, j[off]], np.r_[j, i[off]], np.r_[x, x[off]]
    order = np.argsort(row, kind="stable")
    row, col, value = row[order], col[order], value[order]
    heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    n = len(names)
    diagonal = np.ones(n)
    diagonal[i[~off]] = x[~off]
    given = b.select("i", "b").toArrow()
    r = np.zeros(n)
    at = np.asarray(pc.fill_null(pc.index_in(given["i"].combine_chunks().cast(names.type), names), -1))
    r[at[at >= 0]] = np.asarray(given["b"])[at >= 0]
    solution, p, rz, k = np.zeros(n), r / diagonal, 0.0, 0
    start = norm = float(r @ r)
    rz = float(r @ p)
    while start and (norm / start) ** 0.5 >= tolerance and k < most:
        q = np.zeros(n)
        q[row[heads]] = np.add.reduceat(value * p[col], heads)
        alpha = rz / float(p @ q)
        solution += alpha * p
        r -= alpha * q
        z = r / diagonal
        new, norm = float(r @ z), float(r @ r)
        p = z + (new / rz) * p
        rz, k = new, k + 1
    out = triplets.sparkSession.createDataFrame(pa.table({"i": names, "x": solution}))
    return out, k, (norm / start) ** 0.5 if start else 0.0


def _gradients_there(triplets: DataFrame, b: DataFrame, tolerance: float, most: int) -> tuple[DataFrame, int, float]:
    """The same with matrix and vectors as tables.

    All scalars of an iteration come from one aggregate over one written table, which holds the state and the
    matrix times the preconditioned residual; the state that follows is expressions over it. So an iteration
    is one join, one sum by row, one write and one aggregate, and a lost executor costs one iteration.
    """
    full = written(triplets.select("i", "j", "x").unionByName(triplets.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "x")).repartition("j"), "matrix")
    state = triplets.filter("i = j").select("i", F.col("x").alias("m")).join(b.select("i", "b"), "i", "left")
    zero = F.lit(0.0)
    state = state.select("i", "m", zero.alias("x"), F.coalesce("b", zero).alias("r"), zero.alias("p"), zero.alias("s"))
    start = norm = None
    gamma, alpha, k = 0.0, 0.0, 0
    while True:
        state = state.withColumn("z", F.col("r") / F.col("m"))
        product = full.join(state.select(F.col("i").alias("j"), "z"), "j").groupBy("i").agg(F.sum(F.col("x") * F.col("z")).alias("w"))
        state = written(state.join(product, "i"), "state")
        new, delta, norm = (v or 0.0 for v in state.agg(F.sum(F.col("r") * F.col("z")), F.sum(F.col("w") * F.col("z")), F.sum(F.col("r") * F.col("r"))).first())
        start = norm if start is None else start
        if not start or (norm / start) ** 0.5 < tolerance or k >= most:
            return state.select("i", "x"), k, (norm / start) ** 0.5 if start else 0.0
        beta = new / gamma if k else 0.0
        alpha = new / (delta - beta * new / alpha) if k else new / delta
        gamma, k = new, k + 1
        p, s = F.col("z") + F.col("p") * beta, F.col("w") + F.col("s") * beta
        state = state.select("i", "m", (F.col("x") + p * alpha).alias("x"), (F.col("r") - s * alpha).alias("r"), p.alias("p"), s.alias("s"))
