"""Array entries as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def struct_rows(df: DataFrame, keep: list[str | Column], entries: Column, required: str) -> DataFrame:
    """``keep`` and the fields of each struct in ``entries``; ``required`` is a field never null.

    The outer form, then a filter: for the inner form the optimizer adds a test for empty arrays
    below the projections, and computes a costly array a second time for it.
    """
    return df.select(*keep, F.inline_outer(entries)).where(F.col(required).isNotNull())


def value_rows(df: DataFrame, keep: list[str | Column], values: Column, name: str) -> DataFrame:
    """``keep`` and each entry of ``values`` as ``name``; see ``struct_rows``."""
    return df.select(*keep, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())
