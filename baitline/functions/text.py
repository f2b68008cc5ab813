"""Character-level column expressions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def occurrences(text: Column, literal: str) -> Column:
    """How often a single-character literal occurs."""
    return F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0.0 when ``whole`` is 0."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def flag(condition: Column) -> Column:
    """Boolean to 0/1 int; null counts as 0."""
    return F.when(condition, 1).otherwise(0)


def non_empty_parts(text: Column, separator: str) -> Column:
    """Number of non-empty pieces between separators (single-character separator)."""
    squeezed = F.regexp_replace(text, f"{separator}+", separator)
    inner = F.trim(squeezed, F.lit(separator))
    return F.when(F.length(inner) > 0, occurrences(inner, separator) + 1).otherwise(0)


def any_of(words: list[str]) -> str:
    """Regex alternation over literal words (letters, digits and hyphens only)."""
    return "(?:" + "|".join(words) + ")"


def clip(value: Column, low: float, high: float) -> Column:
    """Value held between two bounds; null stays null (``greatest`` alone would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))
