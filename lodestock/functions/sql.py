"""The scalar functions under SQL names: expressions that Spark puts in place of the call, not user code that it calls."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lodestock.functions.normal import normal_density_sql, normal_quantile_sql


def register(spark: SparkSession) -> list[str]:
    """Make thi(t, rh), heat_load(x, threshold), h2_observed(h2, incidence) and h2_liability(h2, incidence) known to spark.sql; their names."""
    z = normal_density_sql(normal_quantile_sql("incidence"))
    factor = f"({z} * {z} / (incidence * (1 - incidence)))"
    made = {
        "thi(t DOUBLE, rh DOUBLE)": "(1.8D * t + 32) - (0.55D - 0.0055D * rh) * (1.8D * t - 26)",
        "heat_load(x DOUBLE, threshold DOUBLE)": "CASE WHEN x IS NOT NULL THEN greatest(0.0D, x - threshold) END",
        "h2_observed(h2 DOUBLE, incidence DOUBLE)": f"h2 * {factor}",
        "h2_liability(h2 DOUBLE, incidence DOUBLE)": f"h2 / {factor}",
    }
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS DOUBLE RETURN {body}")
    return [head.partition("(")[0] for head in made]
