"""Sums of products kept up to date from a stream of records.

W'W, W'y and y'y add up, so each micro-batch contributes its own sums and nothing old is read again. The
state is a table of the shared folder; a batch that is delivered twice is recognised by its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestock.session import shared_folder


class RunningMeans:
    """Count, sum and sum of squares of a trait by class, from a streaming DataFrame."""

    def __init__(self, spark: SparkSession, by: str, trait: str) -> None:
        self.spark, self.by, self.trait = spark, by, trait
        self.path = shared_folder(spark, "running")

    def start(self, stream: DataFrame):
        def fold(batch: DataFrame, number: int) -> None:
            y = F.col(self.trait).cast("double")
            sums = batch.filter(y.isNotNull()).groupBy(F.col(self.by).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("sum"), F.sum(y * y).alias("squares"))
            sums.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

        return stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{self.path}-state").trigger(availableNow=True).start()

    def table(self) -> DataFrame:
        """(level, n, sum, squares) of all batches so far."""
        rows = self.spark.read.option("basePath", self.path).parquet(self.path)
        return rows.groupBy("level").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.sum("squares").alias("squares"))

    def effects(self, ratio: float) -> DataFrame:
        """(level, n, effect): shrunken deviations of classes at a given ratio of residual to class variance."""
        rows = self.table().withColumn("w", F.col("n") / (F.col("n") + ratio))
        mean = rows.agg((F.sum(F.col("w") * F.col("sum") / F.col("n")) / F.sum("w")).alias("mean"))
        return rows.crossJoin(mean).select("level", "n", (F.col("w") * (F.col("sum") / F.col("n") - F.col("mean"))).alias("effect"))
