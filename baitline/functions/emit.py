"""Computing a group of costly columns exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def emit_once(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """``keep`` plus ``columns``, produced by a one-element generator.

    A plain projection lets the optimizer push a filter on its outputs below it by
    copying their expressions into the filter. For a chain of dependent steps the copies
    multiply until the generated code no longer compiles. A generator is not copied: a
    filter on its outputs stays above it, filters on ``keep`` still pass below.
    """
    packed = F.array(F.struct(*[e.alias(n) for n, e in columns.items()]))
    return df.select(*[F.col(c) for c in keep], F.inline(packed))
