"""Labels of animals and classes: one spelling per level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Codes that mean "unknown" in pedigree and relationship columns.
UNKNOWN = ("0", "", "NA")
EXACT = float(1 << 53)


def canonical_label(df: DataFrame, name: str) -> Column:
    """Numbers as plain digits (100000, never 1e+05), other doubles in their shortest form, text as it is."""
    kind, col = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (col == F.floor(col)) & (F.abs(col) < EXACT)
        return F.when(whole, col.cast("bigint").cast("string")).otherwise(col.cast("string"))
    return col.cast("string")


def is_unknown_animal(label: Column) -> Column:
    return label.isNull() | label.isin(*UNKNOWN)


def is_missing_label(df: DataFrame, name: str) -> Column:
    """Null, not a number or infinite; in text also blank or NaN. The texts NA and Inf are levels."""
    kind, col = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col) | (F.abs(col) == float("inf"))
    if isinstance(kind, T.StringType):
        return col.isNull() | (F.trim(col) == "") | (col == "NaN")
    return col.isNull()


def spelling_key(label: Column) -> Column:
    """What two spellings of one animal have in common: case, blanks, leading zeros, a trailing .0 and accents are dropped."""
    plain = F.translate(F.lower(F.trim(label)), "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"\s+", ""), r"\.0+$", ""), r"^0+(?=.)", "")
