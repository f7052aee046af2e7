"""Bind a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it.

    Without it an expression that is used n times below a CASE is also computed n times.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
