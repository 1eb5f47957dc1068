"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

NAMES = ["thi", "qc_fences", "qc_fence_by", "qc_small_classes", "robust_scale", "a_inverse_dam", "snp_freq", "animal_call_rate", "parentage", "blup_random_intercept", "xtx", "fixed_means", "residuals", "reml_components", "rank_drift", "selection_index", "rhat_classic"]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from lodestock.queries import QUERIES

    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    took = {}
    for name in NAMES:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
