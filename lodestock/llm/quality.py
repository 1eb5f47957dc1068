"""Operator 9: ordinal quality regression.

Labels give each rated document a grade: 0 toxic, 1 poor, 2 good. One weight vector over hashed text is
shared by all grades, and ordered thresholds cut its score: P(grade <= k) = logistic(threshold_k - score).
A document's expected grade and its tail probability P(grade >= 2) follow; documents below a tail
probability are rejected.

A text's features are the hashed lower-case words it has (each once), and the shares of its words that
repeat the one before, stand in capitals, or are odd symbols (runs of them, or others than sentences have). Texts are split and hashed over Arrow
buffers; a prefix sum of byte times power makes every word's polynomial hash one subtraction.

The model is fitted by penalised maximum likelihood on at most `most_labels` rated documents (those whose ids
hash lowest, as far as their features are MOST_FEATURES in all); all documents are scored. A word takes part if
its chi-square over the grades is beyond what the largest of as many words without a bearing on grades would
show, 2 log(words) - which depends on how many words are looked at, not on how many documents are rated - or a
multiple of that. Which multiple, and the penalty, are those under which a quarter of the rated documents, left
out of the fit, are likeliest.

Cases: null and empty texts have no words and get the score of the shares alone; labels with a null, and
ratings of documents that are not there, are left out; of ratings that repeat a doc_id the lowest counts; of
rated rows that repeat a doc_id that whose text hashes lowest; without labels nothing is rejected and the
figures are null; null and repeated doc_ids are kept; an empty table gives no row; other columns are kept by
`select_quality`, whatever their names, and not read by scoring.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestock.llm.common import free_names, mapped, saved, sliced, texts
from lodestock.llm.rolling import mixed, powers, prefix_sums

BITS = 18
#: Features with numbers of their own, before the hashed ones.
SHARES = 3
#: A share's value for all of the words, where a word that is there has value 1.
SCALE = 40.0
#: Rated documents that the model is fitted on, and features of theirs, at most.
MOST_LABELS, MOST_FEATURES = 8000, 4_000_000
#: Multiples of the bound on chi-squares, and penalties on the squares of weights, that are tried.
CUTS, RIDGES = (1.0, 2.0, 3.0, 4.0), (1e-4, 1e-3, 1e-2)
#: A document is kept if P(grade >= 2) is at least this, grades weighing equally in the fit.
KEEP = 0.3

_WORD, _SYMBOL, _SPACE = 0, 1, 2
_KIND = np.array([_SPACE if b <= 32 else _WORD if b >= 128 or chr(b).isalnum() else _SYMBOL for b in range(256)], np.uint8)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
_PLAIN = np.array([chr(b) in ".,;:?!'\"()-" for b in range(256)])
_CAPITAL = np.array([65 <= b <= 90 for b in range(256)], np.int64)


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value) of texts that lie in a row, sorted by document and feature."""
    n_docs = len(at) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    kind = _KIND[data]
    cut = np.r_[True, kind[1:] != kind[:-1]]
    cut[at[:-1][at[:-1] < len(data)]] = True
    begin = np.flatnonzero(cut)
    end = np.r_[begin[1:], len(data)]
    kind = kind[begin]
    keep = kind != _SPACE
    begin, end, kind = begin[keep], end[keep], kind[keep]
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    doc = np.searchsorted(at, begin, "right") - 1
    power, inverse = powers(len(data))
    total = prefix_sums(_LOWER[data], power)
    h = mixed((total[end] - total[begin]) * inverse[begin])
    slot = (h >> np.uint64(64 - BITS)).astype(np.int64) + SHARES
    capitals = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_CAPITAL[data], out=capitals[1:])
    shouts = (capitals[end] - capitals[begin] >= 2) & (capitals[end] - capitals[begin] == end - begin)
    repeats = np.r_[False, (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])]
    n = np.maximum(1, np.bincount(doc, minlength=n_docs))
    odd = (kind == _SYMBOL) & ((end - begin > 1) | ~_PLAIN[data[begin]])
    out_doc, out_slot, out_value = [], [], []
    for k, flag in enumerate((repeats, shouts, odd)):
        out_doc.append(np.arange(n_docs))
        out_slot.append(np.full(n_docs, k))
        out_value.append(SCALE * np.bincount(doc, flag, n_docs) / n)
    pair = np.unique((doc << (BITS + 1)) | slot)
    out_doc.append(pair >> (BITS + 1))
    out_slot.append(pair & ((1 << (BITS + 1)) - 1))
    out_value.append(np.ones(len(pair)))
    doc, slot, value = np.concatenate(out_doc), np.concatenate(out_slot), np.concatenate(out_value)
    order = np.lexsort((slot, doc))
    return doc[order], slot[order], value[order]


@dataclass
class Ordinal:
    """weights over features, thresholds between grades (ascending)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        doc, slot, value = features(data, at)
        return np.bincount(doc, self.weights[slot] * value, len(at) - 1)


def minimize(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, most: int = 300, tolerance: float = 1e-7, held: int = 10) -> np.ndarray:
    """A minimum of f (value and gradient) by limited-memory quasi-Newton steps with halving."""
    value, slope = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    small = 0
    for _ in range(most):
        way, shares = slope.copy(), []
        for s, y in reversed(steps):
            shares.append((s @ way) / (s @ y))
            way -= shares[-1] * y
        way *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, np.abs(slope).sum())
        for (s, y), share in zip(steps, reversed(shares), strict=True):
            way += (share - (y @ way) / (s @ y)) * s
        if way @ slope <= 0:
            way, steps = slope.copy(), []
        part = 1.0
        while True:
            new = x - part * way
            new_value, new_slope = f(new)
            if new_value <= value - 1e-4 * part * (way @ slope) or part < 1e-12:
                break
            part /= 2
        s, y = new - x, new_slope - slope
        if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
            steps = [*steps, (s, y)][-held:]
        small = small + 1 if abs(value - new_value) <= tolerance * max(1e-3, abs(new_value)) else 0
        x, value, slope = new, new_value, new_slope
        if small >= 3:
            break
    return x


def likelihood(doc: np.ndarray, slot: np.ndarray, value: np.ndarray, grade: np.ndarray, n_slots: int, grades: int, ridge: float) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Minus the log-likelihood of the cumulative-link model, each grade with equal weight, and the penalty; with the gradient.

    Parameters are the weights, the first threshold, and the logarithms of the steps between thresholds, which so stay ordered.
    """
    counts = np.bincount(grade, minlength=grades)
    row_weight = (1 / np.maximum(counts, 1))[grade] / max(1, (counts > 0).sum())

    def f(params: np.ndarray) -> tuple[float, np.ndarray]:
        w = params[:n_slots]
        score = np.bincount(doc, w[slot] * value, len(grade))
        bounds = np.r_[-np.inf, cuts(params, n_slots), np.inf]
        above, below = (1 / (1 + np.exp(-np.clip(bounds[grade + k] - score, -500, 500))) for k in (1, 0))
        above, below = np.where(grade == grades - 1, 1.0, above), np.where(grade == 0, 0.0, below)
        p = np.maximum(above - below, 1e-300)
        da, db = row_weight * above * (1 - above) / p, row_weight * below * (1 - below) / p
        d_theta = np.array([(db[grade == k + 1]).sum() - (da[grade == k]).sum() for k in range(grades - 1)])
        d_steps = [d_theta[k:].sum() * np.exp(params[n_slots + k]) for k in range(1, grades - 1)]
        slope = np.r_[np.bincount(slot, (da - db)[doc] * value, n_slots) + ridge * w, d_theta.sum(), d_steps]
        return float(-(row_weight * np.log(p)).sum() + ridge / 2 * (w @ w)), slope

    return f


def cuts(params: np.ndarray, n_slots: int) -> np.ndarray:
    """The thresholds among the parameters of likelihood."""
    return np.cumsum(np.r_[params[n_slots], np.exp(np.minimum(params[n_slots + 1 :], 50))])


def fit_given(doc: np.ndarray, slot: np.ndarray, value: np.ndarray, grade: np.ndarray, use: np.ndarray, grades: int, ridge: float) -> Ordinal:
    """The model over the features that use is true for."""
    keep = use[slot]
    used, local = np.unique(slot[keep], return_inverse=True)
    f = likelihood(doc[keep], local, value[keep], grade, len(used), grades, ridge)
    params = minimize(f, np.r_[np.zeros(len(used)), -1.0, np.zeros(grades - 2)])
    weights = np.zeros(len(use))
    weights[used] = params[: len(used)]
    return Ordinal(weights, cuts(params, len(used)))


def bearing(doc: np.ndarray, slot: np.ndarray, grade: np.ndarray, grades: int, n_slots: int) -> np.ndarray:
    """Each feature's chi-square over the grades, as a multiple of what the largest of as many features without a bearing would show."""
    counts, n = np.bincount(grade, minlength=grades), len(grade)
    seen = np.stack([np.bincount(slot[grade[doc] == g], minlength=n_slots) for g in range(grades)]).astype(float)
    total = seen.sum(0)
    there, not_there = total * (counts / max(1, n))[:, None], (n - total) * (counts / max(1, n))[:, None]
    chi2 = ((seen - there) ** 2 * (1 / np.maximum(there, 1e-9) + 1 / np.maximum(not_there, 1e-9))).sum(0)
    # in one document, or in all, a word tells nothing that the next one bears out
    chi2[(total < 2) | (total == n)] = 0
    return chi2 / (2 * np.log(max(2, int((total[SHARES:] > 1).sum()))))


def fit_ordinal(doc: np.ndarray, slot: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int = 3) -> Ordinal:
    """The cumulative-link model of documents' features and grades. Rows of features lie in the order of documents."""
    n_slots = SHARES + (1 << BITS)

    def use(part: np.ndarray, cut: float) -> np.ndarray:
        own = part[doc]
        place = np.cumsum(part) - 1
        out = bearing(place[doc[own]], slot[own], grade[part], grades, n_slots) >= cut
        out[:SHARES] = True
        return out

    def held_out(fold: np.ndarray, at: np.ndarray, ridge: float) -> float:
        """Mean minus log-likelihood, grades weighing equally, of the documents left out."""
        own, place = ~fold[doc], np.cumsum(~fold) - 1
        model = fit_given(place[doc[own]], slot[own], value[own], grade[~fold], at, grades, ridge)
        score = np.bincount(doc, model.weights[slot] * value, len(grade))[fold]
        tails = np.c_[np.ones(fold.sum()), model.tails(score), np.zeros(fold.sum())]
        found = -np.log(np.maximum(tails[np.arange(len(tails)), grade[fold]] - tails[np.arange(len(tails)), grade[fold] + 1], 1e-12))
        return float(np.mean([found[grade[fold] == g].mean() for g in np.unique(grade[fold])]))

    cut, ridge = CUTS[0], RIDGES[0]
    fold = np.arange(len(grade)) % 4 == 3
    if len(np.unique(grade[~fold])) == len(np.unique(grade)) > 1 and fold.any():
        at = {c: use(~fold, c) for c in CUTS}
        cut = min(CUTS, key=lambda c: held_out(fold, at[c], RIDGES[0]))
        ridge = min(RIDGES, key=lambda r: held_out(fold, at[cut], r))
    return fit_given(doc, slot, value, grade, use(np.ones(len(grade), bool), cut), grades, ridge)


def grades(labels: DataFrame, most_labels: int) -> DataFrame:
    """doc_id, grade of at most most_labels rated documents: those whose ids hash lowest."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").dropna()
    known = known.groupBy("doc_id").agg(F.min(grade).alias("grade"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)


def train(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> Ordinal | None:
    """The model of the rated documents; the driver holds features of most_labels documents at most."""
    rated = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rated = rated.join(F.broadcast(grades(labels, most_labels)), "doc_id")
    rated = rated.groupBy("doc_id", "grade").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=2 << 20):
            data, at = texts(batch)
            doc, slot, value = features(data, at)
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            parts = [(slot[a:b].astype("<i4").tobytes(), value[a:b].astype("<f4").tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "grade": batch.column(1), "slots": pa.array([p[0] for p in parts], pa.binary()), "shares": pa.array([p[1] for p in parts], pa.binary())})

    rows = saved(mapped(rated.select("doc_id", "grade", "text"), gather, "doc_id long, grade int, slots binary, shares binary"), "rated")
    sizes = rows.select("doc_id", F.octet_length("slots").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()  # most_labels rows at most
    few = np.asarray(sizes["doc_id"])[np.cumsum(np.asarray(sizes["n"]) // 4) <= MOST_FEATURES].tolist()
    if not few:
        return None
    few = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in few], "doc_id long"))
    rows = rows.join(few, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    slots = [np.frombuffer(x, "<i4") for x in rows["slots"].to_pylist()]
    doc = np.repeat(np.arange(len(slots), dtype=np.int32), list(map(len, slots)))
    value = np.concatenate([np.frombuffer(x, "<f4") for x in rows["shares"].to_pylist()])
    return fit_ordinal(doc, np.concatenate(slots), value, np.asarray(rows["grade"]).astype(np.int64))


NAMES = ("_score", "_expected_grade", "_p_good", "_kept")


def score_quality(docs: DataFrame, model: Ordinal | None, keep: float = KEEP, names: tuple[str, ...] = NAMES) -> DataFrame:
    """docs with score, expected grade, P(grade >= 2) and whether the document is kept, under four names that docs must not have."""
    if model is None:
        return docs.select("*", *[F.lit(None).cast("double").alias(n) for n in names[:3]], F.lit(True).alias(names[3]))
    weights, thresholds = model.weights.astype("<f4"), model.thresholds

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ordinal(weights, thresholds)
        for batch in sliced(batches, most=2 << 20):
            s = own.scores(*texts(batch))
            tails = own.tails(s)
            for name, col in zip(names, (s, tails.sum(1), tails[:, -1], tails[:, -1] >= keep), strict=True):
                batch = batch.append_column(name, pa.array(col))
            yield batch

    schema = docs.select("*", *[F.lit(0.0).alias(n) for n in names[:3]], F.lit(True).alias(names[3])).schema
    return mapped(docs, score, schema)


def select_quality(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The rows of docs that the model does not reject, with their columns."""
    names = tuple(free_names(docs, "score", "expected_grade", "p_good", "kept"))
    return score_quality(docs, train(docs, labels), keep, names).filter(F.col(names[3])).select(docs.columns)


def op9_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_quality(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", F.col("_score").alias("score"), F.col("_expected_grade").alias("expected_grade"), F.col("_p_good").alias("p_good"), F.col("_kept").alias("kept"))
