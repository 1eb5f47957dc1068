"""Selection index and ranking drift."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestock.session import written


def selection_index(evaluations: list[DataFrame], weights: list[float], standardize: bool = True) -> DataFrame:
    """id, index: the weighted sum of evaluations (each id, ebv) of animals that have all of them, by default in standard deviations."""
    if len(evaluations) != len(weights):
        raise ValueError("one weight for each evaluation")
    named = [e.select("id", F.col("ebv").cast("double").alias(f"_e{k}")).filter(F.col("ebv").isNotNull()) for k, e in enumerate(evaluations)]
    rows = reduce(lambda a, b: a.join(b, "id"), named)
    scale = [1.0] * len(weights)
    if standardize:
        scale = list(rows.agg(*[F.stddev_samp(f"_e{k}") for k in range(len(weights))]).first())
        if any(not s for s in scale):
            raise ValueError("an evaluation without variance cannot be standardized")
    total = reduce(lambda a, b: a + b, [F.col(f"_e{k}") * (w / s) for k, (w, s) in enumerate(zip(weights, scale, strict=True))])
    return rows.select("id", total.alias("index")).orderBy(F.desc("index"), "id")


def ranks(df: DataFrame, name: str) -> DataFrame:
    """df with `rank_<name>`, 1 for the largest, ties averaged.

    Values are counted, dealt by range and ranked within their range; the ranges' sums, a row each, are the
    driver's. So no task orders all values.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(F.col(name).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    dealt = written(counts.repartitionByRange(n, F.desc("_v")).withColumn("_p", F.spark_partition_id()), "ranks")
    before, total = [], 0
    for r in dealt.groupBy("_p").agg(F.sum("_n").alias("n")).orderBy("_p").collect():
        before.append((r["_p"], total))
        total += r.n
    upto = F.sum("_n").over(Window.partitionBy("_p").orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, 0))
    offsets = df.sparkSession.createDataFrame(pa.table({"_p": pa.array([p for p, _ in before], pa.int32()), "_b": pa.array([b for _, b in before], pa.int64())}))  # a row a partition
    placed = dealt.withColumn("_u", upto).join(F.broadcast(offsets), "_p").select("_v", (F.col("_b") + F.col("_u") - (F.col("_n") - 1) / 2).alias(f"rank_{name}"))
    return df.join(placed, F.col(name) == F.col("_v")).drop("_v")


def in_all(tables: list[DataFrame], without: DataFrame | None = None) -> DataFrame:
    """The ids that all tables have and `without` has not, each once."""
    ids = reduce(lambda a, b: a.join(b.select("id"), "id", "left_semi"), [t.select("id") for t in tables]).distinct()
    return ids if without is None else ids.join(without.select("id"), "id", "left_anti")


def top(df: DataFrame, name: str, most: int) -> DataFrame:
    """The ids of the largest values, ties by id."""
    return df.orderBy(F.desc(name), "id").limit(most).select("id")


def common_ranks(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, old, new, rank_old, rank_new of animals in both evaluations (each id, ebv)."""
    rows = old.select("id", F.col("ebv").alias("old")).join(new.select("id", F.col("ebv").alias("new")), "id")
    return ranks(ranks(rows, "old"), "new")


def rank_drift(old: DataFrame, new: DataFrame, most: int = 100) -> DataFrame:
    """One row: n_common, pearson, spearman, top, retained - how many of the old top are in the new one (ties by id)."""
    rows = common_ranks(old, new)
    n = rows.count()
    if n < 3:
        raise ValueError(f"{n} animals in common")
    most = min(most, n)
    kept = top(rows, "new", most).join(top(rows, "old", most), "id").agg(F.count(F.lit(1)).alias("retained"))
    found = rows.agg(F.count(F.lit(1)).alias("n_common"), F.corr("old", "new").alias("pearson"), F.corr("rank_old", "rank_new").alias("spearman"))
    return found.crossJoin(kept).withColumn("top", F.lit(most))


def rank_movers(old: DataFrame, new: DataFrame, most: int = 10) -> DataFrame:
    """The animals whose rank changed most: id, rank_old, rank_new, change (positive: up)."""
    rows = common_ranks(old, new).withColumn("change", F.col("rank_old") - F.col("rank_new"))
    return rows.orderBy(F.desc(F.abs("change")), "id").limit(most).select("id", "rank_old", "rank_new", "change")
