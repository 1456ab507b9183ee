"""Expression plumbing shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Lambdas get no common-subexpression elimination, so a value used inside one is named this way.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_div(c: Column | str, n: int) -> Column:
    """Whole part of ``c / n`` for whole numbers, rounded down, without loss for large values."""
    value = as_column(c)
    return ((value - F.pmod(value, F.lit(n))) / n).cast("bigint")
