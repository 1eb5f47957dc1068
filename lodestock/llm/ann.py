"""Operator 5: approximate nearest neighbours by an inverted file with product-quantised residuals.

Coarse centroids and residual codebooks are fitted by k-means on a bounded sample (those rows whose ids hash
lowest); every row is then indexed: its list is the nearest centroid's, its code the nearest codeword of each
part of the residual. A query takes the lists in the order of its inner product with their centroids. First it
searches as many as hold four times the neighbours asked for, all lists if need be, so it has an answer from
the index whatever follows; the worst of these is its floor. Then it searches the other lists it probes, as many
as hold a set share of the true neighbours of sample rows within the sample - few where the vectors form
clusters, most where they do not - for what reaches the floor. Answers come from the lists alone.

Within a list, a table of the query's inner products with all codewords gives each member's approximate score
by look-ups; every member whose approximate score and what its code leaves of it can reach the query's best is
scored anew on the original vectors in double precision.

A list may hold a third of all rows, and a third of the queries may probe it: its members and its queries
are cut into blocks of bounded size, and each pair of blocks is a group of its own.

Cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do null ids;
nor do vectors of another length than most (of lengths held as often the shortest counts), as they have no
inner product with the others. Rows that repeat a vec_id are rows of their own: each is a candidate of the
others, and each that is a query has a ranking of its own. Ties go to the smaller vec_id; with fewer candidates
than asked for all come back; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestock.llm.common import mapped, saved

#: Rows that centroids and codebooks are fitted on: SAMPLE, or EACH times the lists if that is more, MOST_SAMPLE and SAMPLE_BYTES (in single precision) at most.
SAMPLE, EACH, MOST_SAMPLE, SAMPLE_BYTES = 16_384, 64, 262_144, 64 << 20
#: Lists: the root of the number of rows, and no more than leave each LEAST rows of the sample.
LEAST = 32
#: Share of true neighbours in the sample that the probed lists must hold, how many sample rows ask, and the least number of lists probed.
HELD, ASKED, PROBES = 0.96, 512, 8
#: Members of the lists searched first, as a multiple of the neighbours asked for.
FIRST = 4
#: Parts of a vector that have codebooks of their own, and candidates of each block that are scored anew first.
PARTS, CODES, RERANK = 16, 256, 40
#: Members, and queries, of a block.
MEMBERS, QUERIES = 4096, 1024


@dataclass
class Coarse:
    centroids: np.ndarray  # lists x dim
    books: np.ndarray  # parts x codes x dim of a part (dim padded to parts)

    def split(self, x: np.ndarray) -> np.ndarray:
        parts, _, width = self.books.shape
        full = np.zeros((len(x), parts * width), np.float32)
        full[:, : x.shape[1]] = x
        return full.reshape(len(x), parts, width)

    def lists(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centroids)

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = self.split(x - self.centroids[lists])
        return np.stack([_nearest(rest[:, p], self.books[p]) for p in range(len(self.books))], 1).astype(np.uint8)


    def decoded(self, centre: int, codes: np.ndarray) -> np.ndarray:
        """What the codes of members of a list stand for, split into parts."""
        own = np.stack([self.books[p][codes[:, p]] for p in range(len(self.books))], 1)
        return self.split(self.centroids[centre][None, :]) + own


def _nearest(x: np.ndarray, centres: np.ndarray, step: int = 4096) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmax(x[k : k + step] @ centres.T - half, 1) for k in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Centres of at most k clusters; a cluster that falls empty starts anew at a row."""
    if len(x) <= k:
        return x.copy()
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        order = np.argsort(own, kind="stable")
        kinds, first, n = np.unique(own[order], return_index=True, return_counts=True)
        centres[kinds] = np.add.reduceat(x[order], first, axis=0) / n[:, None]
        empty = np.setdiff1d(np.arange(k), kinds)
        centres[empty] = x[rng.choice(len(x), len(empty))]
    return centres


def fit(sample: np.ndarray, lists: int, seed: int = 7) -> Coarse:
    """Centroids and codebooks of a sample, equal rows of which count once."""
    rng = np.random.default_rng(seed)
    x = np.unique(sample.astype(np.float32), axis=0)
    centroids = _kmeans(x, lists, rng)
    parts = min(PARTS, x.shape[1])
    width = -(-x.shape[1] // parts)
    out = Coarse(centroids, np.zeros((parts, 1, width), np.float32))
    rest = out.split(x - centroids[_nearest(x, centroids)])
    books = [_kmeans(np.unique(rest[:, p], axis=0), CODES, rng, 5) for p in range(parts)]
    out.books = np.full((parts, max(map(len, books)), width), 1e30, np.float32)  # absent codewords are far from all
    for p, b in enumerate(books):
        out.books[p, : len(b)] = b
    return out


def usable(table: DataFrame) -> DataFrame:
    """vec_id, vec (the vector's components as little-endian doubles) of the rows that take part, whatever their length."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.and_(pc.is_valid(batch.column(0)), pc.is_valid(batch.column(1))))
            if not batch.num_rows:
                continue
            col = batch.column(1)
            at = np.asarray(col.offsets).astype(np.int64)
            at = at - at[0]
            flat = np.asarray(col.flatten().cast(pa.float64()).fill_null(np.nan))
            bad, live = np.r_[0, np.cumsum(~np.isfinite(flat))], np.r_[0, np.cumsum(flat != 0)]
            good = (bad[at[1:]] == bad[at[:-1]]) & (live[at[1:]] > live[at[:-1]])
            raw = flat.astype("<f8").tobytes()
            rows = np.flatnonzero(good)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0).take(pa.array(rows)), "vec": pa.array([raw[8 * at[k] : 8 * at[k + 1]] for k in rows.tolist()], pa.binary())})

    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    return mapped(rows, pack, "vec_id long, vec binary")


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = col.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)


def score_block(coarse: Coarse, centre: int, query: np.ndarray, q: np.ndarray, member: np.ndarray, codes: np.ndarray, x: np.ndarray, k: int, rerank: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, place of the member, score) of each query's k best among the members of one block that reach the query's floor.

    query, member: numbers of rows; a query is no candidate of its own. Members are in ascending vec_id, so ties keep that order.
    A member's score lies within |query| * |what its code leaves of it| of the approximate one (Cauchy-Schwarz).
    The `rerank` best by the upper bound are scored exactly, then all others whose upper bound reaches the
    k-th best score so far and the floor: none of a block's k best is lost.
    """
    table = np.einsum("qpw,pcw->pqc", coarse.split(q.astype(np.float32)), np.where(coarse.books < 1e29, coarse.books, 0))
    near = np.repeat((q.astype(np.float32) @ coarse.centroids[centre])[:, None], len(member), 1)
    for p in range(len(table)):
        near += table[p][:, codes[:, p]]
    left = np.linalg.norm(coarse.split(x) - coarse.decoded(centre, codes), axis=(1, 2))
    length = np.linalg.norm(q, axis=1)
    # what single precision can be wrong by: of the sums, relative to the lengths that go into them
    most_off = 1e-5 * length[:, None] * (np.linalg.norm(x, axis=1) + np.linalg.norm(coarse.centroids[centre]) + left)[None, :]
    upper = near + length[:, None] * left[None, :] + most_off
    upper[query[:, None] == member[None, :]] = -np.inf
    most = min(max(rerank, k), len(member))
    best = np.argpartition(upper, len(member) - most, 1)[:, len(member) - most :]
    exact = np.full(upper.shape, -np.inf)

    def fill(r: np.ndarray, c: np.ndarray) -> None:
        for at in range(0, len(r), 1 << 15):  # one way of summing for all pairs, so equal vectors tie
            i, j = r[at : at + (1 << 15)], c[at : at + (1 << 15)]
            exact[i, j] = np.einsum("nd,nd->n", q[i], x[j])

    at = np.zeros(upper.shape, bool)
    np.put_along_axis(at, best, True, 1)
    fill(*np.nonzero(at & (upper > -np.inf)))
    limit = np.maximum(floor, np.partition(exact, len(member) - min(k, len(member)), 1)[:, len(member) - min(k, len(member))])
    fill(*np.nonzero((upper >= limit[:, None]) & (exact == -np.inf) & (upper > -np.inf)))
    order = np.argsort(-exact, 1, kind="stable")[:, :k]
    score = np.take_along_axis(exact, order, 1)
    r, c = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
    return r, order[r, c], score[r, c]


def needed_probes(coarse: Coarse, sample: np.ndarray, k: int, held: float = HELD, asked: int = ASKED) -> int:
    """How many lists, in the order a query probes them, hold the share `held` of the k nearest within the sample."""
    x = np.unique(sample.astype(np.float32), axis=0)
    rows = np.random.default_rng(11).permutation(len(x))[:asked]
    lists = coarse.lists(x)
    ranks = []
    for r in rows:
        score = x @ x[r]
        score[r] = -np.inf
        true = np.argsort(-score, kind="stable")[: min(k, len(x) - 1)]
        place = np.empty(len(coarse.centroids), np.int64)
        place[np.argsort(-(coarse.centroids @ x[r]), kind="stable")] = np.arange(len(place))
        ranks.append(place[lists[true]])
    ranks = np.sort(np.concatenate(ranks)) if ranks else np.zeros(0, np.int64)
    return int(ranks[min(len(ranks) - 1, int(held * len(ranks)))]) + 1 if len(ranks) else 1


def fitted(rows: DataFrame, total: int, dim: int, k: int) -> tuple[Coarse, int]:
    """The index's centroids and codebooks for so many rows, and how many lists a query probes."""
    lists = max(1, int(total**0.5))
    most = max(1, min(max(SAMPLE, EACH * lists), MOST_SAMPLE, SAMPLE_BYTES // (4 * dim)))
    sample = _matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(most).select(F.col("vec")).toArrow()["vec"]).astype(np.float32)
    coarse = fit(sample, min(lists, max(1, len(sample) // LEAST)))
    return coarse, max(PROBES, needed_probes(coarse, sample, k))


def nearest(table: DataFrame, is_query: str, k: int, probes: int | None = None, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which the SQL condition is_query holds."""
    spark = table.sparkSession
    vectors = saved(usable(table).withColumn("row", F.monotonically_increasing_id()), "vectors")
    widths = vectors.groupBy(F.octet_length("vec").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = vectors.filter(F.octet_length("vec") == widths[0].w)
    coarse, needed = fitted(rows, widths[0].n, widths[0].w // 8, k)
    lists, probes = len(coarse.centroids), probes or needed

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1)).astype(np.float32)
                own = coarse.lists(x)
                codes = coarse.codes(x, own)
                yield pa.RecordBatch.from_pydict({"list": pa.array(own, pa.int64()), "vec_id": batch.column(0), "row": batch.column(2), "code": pa.array([c.tobytes() for c in codes], pa.binary()), "vec": batch.column(1)})

    indexed = saved(mapped(rows, index, "list long, vec_id long, row long, code binary, vec binary"), "ivf")
    held = {r.list: r.n for r in indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a list
    counts = np.array([held.get(c, 0) for c in range(lists)])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                order = np.argsort(-(_matrix(part.column(1)).astype(np.float32) @ coarse.centroids.T), 1, kind="stable")
                before = np.cumsum(counts[order], 1) - counts[order]
                first = before <= FIRST * k
                r, c = np.nonzero(((np.arange(lists)[None, :] < probes) | first) & (counts[order] > 0))
                yield pa.RecordBatch.from_pydict({"list": pa.array(order[r, c]), "query_row": part.column(2).take(pa.array(r)), "query_id": part.column(0).take(pa.array(r)), "vec": part.column(1).take(pa.array(r)), "first": pa.array(first[r, c])})

    asked = saved(mapped(rows.filter(is_query), route, "list long, query_row long, query_id long, vec binary, first boolean"), "probes")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    kept = ["query_row", "query_id", "vec_id", "row", "score"]

    def search(asked: DataFrame) -> DataFrame:
        """kept columns: each query's best in the lists it asks, of those that reach its floor."""
        plan = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("long").alias("nq"))
        plan = F.broadcast(plan.join(F.broadcast(spark.createDataFrame([(c, -(-n // MEMBERS)) for c, n in held.items()], "list long, nm long")), "list"))
        key = ["list", "m", "q"]
        members = indexed.join(plan, "list").withColumn("m", F.expr("pmod(xxhash64(row), nm)")).withColumn("q", F.explode(F.expr("sequence(0L, nq - 1)"))).drop("nq", "nm")
        asked = asked.join(plan, "list").withColumn("q", F.expr("pmod(xxhash64(query_row), nq)")).withColumn("m", F.explode(F.expr("sequence(0L, nm - 1)"))).drop("nq", "nm")

        def blocks(left: pa.Table, right: pa.Table) -> pa.Table:
            r, c, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            if left.num_rows and right.num_rows:
                left = left.sort_by([("vec_id", "ascending"), ("row", "ascending")])
                codes = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(left.num_rows, -1)
                r, c, score = score_block(coarse, left["list"][0].as_py(), np.asarray(right["query_row"]), _matrix(right["vec"]), np.asarray(left["row"]), codes, _matrix(left["vec"]), k, rerank, np.asarray(right["floor"]))
            return pa.table({"query_row": right["query_row"].take(pa.array(r)), "query_id": right["query_id"].take(pa.array(r)), "vec_id": left["vec_id"].take(pa.array(c)), "row": left["row"].take(pa.array(c)), "score": pa.array(score, pa.float64())})

        return members.groupBy(key).cogroup(asked.groupBy(key)).applyInArrow(blocks, "query_row long, query_id long, vec_id long, row long, score double")

    def top(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    near = saved(top(search(asked.filter("first").withColumn("floor", F.lit(float("-inf"))))).select(*kept), "first-found")
    floor = near.groupBy("query_row").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("floor"))
    rest = asked.filter("not first").join(floor, "query_row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    return top(near.unionByName(search(rest).select(*kept))).select("query_id", "rank", "vec_id", "score")


def op5_ivfpq_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 20 = 0", 20)
