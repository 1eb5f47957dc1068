"""Environment scales and the normalised Legendre basis."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def thi(temperature: Column, humidity: Column) -> Column:
    """Temperature-humidity index (degrees Celsius, per cent); a humidity outside 0 to 100 is an error."""
    warm = temperature * 1.8
    index = (warm + 32) - (F.lit(0.55) - humidity * 0.0055) * (warm - 26)
    return F.when(humidity.between(0, 100) | humidity.isNull(), index).otherwise(F.raise_error(F.lit("relative humidity must lie between 0 and 100")).cast("double"))


def heat_load(x: Column, threshold: float = 68.0) -> Column:
    """Units above the threshold, else 0."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), x - threshold))


def legendre(x: Column, order: int, low: float, high: float) -> list[Column]:
    """Normalised polynomials phi_0 .. phi_order of x scaled from [low, high] to [-1, 1]."""
    if not high > low:
        raise ValueError("the limits of a Legendre basis must differ")
    z = (x - low) * (2.0 / (high - low)) - 1.0
    plain = [F.lit(1.0), z]
    for n in range(1, order):
        plain.append((z * plain[n] * float(2 * n + 1) - plain[n - 1] * float(n)) / float(n + 1))
    return [p * math.sqrt((2 * n + 1) / 2) for n, p in enumerate(plain[: order + 1])]


def legendre_columns(df: DataFrame, name: str, order: int = 1, limits: tuple[float, float] | None = None) -> DataFrame:
    """df with phi0 .. phiN of a column; by default the limits are the observed range (one aggregate)."""
    low, high = limits or df.agg(F.min(name), F.max(name)).first()
    return df.withColumns({f"phi{n}": c for n, c in enumerate(legendre(F.col(name), order, float(low), float(high)))})
