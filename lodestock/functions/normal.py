"""The normal distribution as SQL text: the same rational approximation runs here and in any oracle.

Quantiles are Acklam's rational approximation (relative error under 1.2e-9).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The coefficients of the approximation, highest power first.
CENTRE_TOP = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
CENTRE_BOTTOM = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
TAIL_TOP = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
TAIL_BOTTOM = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
TAIL = 0.02425


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    out = f"cast({coefficients[0]!r} as double)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + cast({c!r} as double))"
    return out


def normal_quantile_sql(p: str) -> str:
    """SQL for the standard normal quantile of the SQL expression p."""
    centre, q = f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))"

    def tail(x: str) -> str:
        r = f"sqrt(-2 * ln({x}))"
        return f"({_horner(TAIL_TOP, r)} / {_horner(TAIL_BOTTOM, r)})"

    middle = f"({centre} * {_horner(CENTRE_TOP, q)} / {_horner(CENTRE_BOTTOM, q)})"
    return f"case when {p} < {TAIL} then {tail(p)} when {p} > {1 - TAIL} then -{tail(f'(1 - {p})')} else {middle} end"


def normal_density_sql(x: str) -> str:
    return f"(exp(-({x}) * ({x}) / 2) * cast(0.3989422804014327 as double))"


def _factor(incidence: str) -> str:
    z = normal_density_sql(normal_quantile_sql(incidence))
    return f"({z} * {z} / ({incidence} * (1 - {incidence})))"


def h2_observed(h2: str, incidence: str) -> Column:
    """Heritability on the observed 0/1 scale, of SQL expressions for the liability's and the incidence."""
    return F.expr(f"({h2}) * {_factor(incidence)}")


def h2_liability(h2: str, incidence: str) -> Column:
    """Heritability on the liability scale."""
    return F.expr(f"({h2}) / {_factor(incidence)}")
