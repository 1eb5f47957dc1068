"""A simulated population: founders, random mating, Mendelian sampling; one table a generation, joined to its parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestock.session import written


def _uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) that depends on the keys only: draws are the same on any partitioning."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _normal(seed: int, *keys: Column) -> Column:
    return F.sqrt(-2 * F.log(_uniform(seed, F.lit("r"), *keys))) * F.cos(_uniform(seed, F.lit("t"), *keys) * 6.283185307179586)


def simulate_population(spark: SparkSession, founders: int = 40, generations: int = 3, offspring: int = 60, h2: float = 0.4, seed: int = 1) -> DataFrame:
    """(id, sire, dam, gen, tbv, cg, y): y = 10 + tbv + e, of variance 1 in all, cg one of three groups.

    Parents of a generation are drawn from the one before, males having odd numbers.
    """
    va = h2
    who = F.col("k")
    now = spark.range(founders).select(F.col("id").alias("k"), F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("d"), F.lit(0).alias("gen"), (_normal(seed, F.col("id"), F.lit("tbv")) * va**0.5).alias("tbv"))
    out, low, size = [written(now, "population")], 0, founders
    for g in range(1, generations + 1):
        before, start = out[-1], low + size
        half = max(1, size // 2)
        new = spark.range(start, start + offspring).select(F.col("id").alias("k"), (F.floor(_uniform(seed, F.col("id"), F.lit("s")) * half) * 2 + low).cast("long").alias("s"), (F.floor(_uniform(seed, F.col("id"), F.lit("d")) * half) * 2 + low + 1).cast("long").alias("d"))
        new = new.join(before.select(F.col("k").alias("s"), F.col("tbv").alias("ts")), "s").join(before.select(F.col("k").alias("d"), F.col("tbv").alias("td")), "d")
        new = new.select("k", "s", "d", F.lit(g).alias("gen"), ((F.col("ts") + F.col("td")) / 2 + _normal(seed, who, F.lit("m")) * (va / 2) ** 0.5).alias("tbv"))
        out.append(written(new, "population"))
        low, size = start, offspring
    every = out[0]
    for t in out[1:]:
        every = every.unionByName(t)
    label = lambda c: F.concat(F.lit("a"), F.col(c) + 1)
    group = F.concat(F.lit("g"), (F.floor(_uniform(seed, who, F.lit("cg")) * 3) + 1).cast("string"))
    return every.select(label("k").alias("id"), F.coalesce(label("s"), F.lit("0")).alias("sire"), F.coalesce(label("d"), F.lit("0")).alias("dam"), "gen", "tbv", group.alias("cg"), (F.lit(10.0) + F.col("tbv") + _normal(seed, who, F.lit("e")) * (1 - h2) ** 0.5).alias("y"))


def simulate_genotypes(population: DataFrame, markers: int = 100, seed: int = 1) -> DataFrame:
    """(id, marker, dosage) of a simulated population: founders' genes drawn by frequencies from 0.1 to 0.9, each offspring taking one of the two of either parent, loci unlinked and without effect on tbv.

    Two arrays an animal; one join of a generation with its parents.
    """
    spots = F.sequence(F.lit(0), F.lit(markers - 1))
    who = F.col("id")
    founder = lambda side: F.transform(spots, lambda k: (_uniform(seed, who, F.lit(side), k) < _uniform(seed, F.lit("p"), k) * 0.8 + 0.1).cast("byte"))
    gamete = lambda p: F.transform(spots, lambda k: F.when(_uniform(seed, who, F.lit(p), k) < 0.5, F.get(f"{p}1", k)).otherwise(F.get(f"{p}2", k)))
    out = [written(population.filter("gen = 0").select("id", founder("a").alias("one"), founder("b").alias("two")), "genes")]
    for g in range(1, population.agg(F.max("gen")).first()[0] + 1):
        parent = lambda p, own=out[-1]: own.select(F.col("id").alias(p), F.col("one").alias(f"{p}1"), F.col("two").alias(f"{p}2"))
        young = population.filter(F.col("gen") == g).select("id", "sire", "dam").join(parent("sire"), "sire").join(parent("dam"), "dam")
        out.append(written(young.select("id", gamete("sire").alias("one"), gamete("dam").alias("two")), "genes"))
    every = out[0]
    for t in out[1:]:
        every = every.unionByName(t)
    cells = every.select("id", F.posexplode(F.zip_with("one", "two", lambda a, b: a + b)).alias("at", "dosage"))
    return cells.select("id", F.concat(F.lit("m"), (F.col("at") + 1).cast("string")).alias("marker"), F.col("dosage").cast("byte").alias("dosage"))
