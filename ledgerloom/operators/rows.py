"""Row selection helpers used across areas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    The rank filter lets Spark keep only each task's best row per key before the shuffle, so a key
    with very many rows sends one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def with_earlier(
    df: DataFrame, keys: Sequence[str], ordinal: str, lag: int, values: dict[str, str]
) -> DataFrame:
    """Add the values found exactly ``lag`` ordinals earlier under the same keys; a gap gives null.

    ``values`` maps new column names to existing ones. (keys, ordinal) must be unique, so the rows
    of one key are bounded by the number of ordinals.
    """
    there = Window.partitionBy(*keys).orderBy(ordinal).rangeBetween(-lag, -lag)
    return df.withColumns({new: F.last(src).over(there) for new, src in values.items()})
