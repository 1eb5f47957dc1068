"""Column functions: all JVM-side expressions."""

from lodestock.functions.basis import heat_load, legendre, legendre_columns, thi
from lodestock.functions.labels import canonical_label, is_missing_label, is_unknown_animal, spelling_key
from lodestock.functions.normal import h2_liability, h2_observed, normal_density_sql, normal_quantile_sql
from lodestock.functions.sql import register

__all__ = ["canonical_label", "h2_liability", "h2_observed", "heat_load", "is_missing_label", "is_unknown_animal", "legendre", "legendre_columns", "normal_density_sql", "normal_quantile_sql", "register", "spelling_key", "thi"]
