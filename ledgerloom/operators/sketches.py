"""Percentiles from sketches that are kept per day and merged for any span of days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.core import floor_div

DAY_MICROS = 86_400_000_000
# Size parameter of a sketch; a few kilobytes each.
SIZE = 400


def rank_error(size: int = SIZE) -> float:
    """By how much of all rows the rank of a sketched percentile may be off, far beyond the usual error of this size."""
    return 4 / size**0.9


def daily_sketches(df: DataFrame, by: Sequence[str], value: str, ts: str, size: int = SIZE) -> DataFrame:
    """(*by, day, rows, sketch): a KLL sketch of the whole-number ``value`` per group and UTC day.

    Tasks sketch their own rows, so only sketches are shuffled. Days are counted from 1970; rows without a value count nowhere.
    """
    day = floor_div(F.unix_micros(ts), DAY_MICROS).cast("int")
    given = df.filter(F.col(value).isNotNull()).withColumn("day", day)
    sketch = F.kll_sketch_agg_bigint(F.col(value).cast("bigint"), F.lit(size))
    return given.groupBy(*by, "day").agg(F.count(F.lit(1)).alias("rows"), sketch.alias("sketch"))


def sketched_percentiles(sketches: DataFrame, by: Sequence[str], points: Sequence[float]) -> DataFrame:
    """(*by, days, rows, p50, ...): percentiles over all days of ``sketches``, without the rows themselves.

    A percentile's rank is off by at most :func:`rank_error` of the rows; the exact way is :func:`exact_percentiles`.
    """
    merged = sketches.groupBy(*by).agg(
        F.count(F.lit(1)).alias("days"), F.sum("rows").alias("rows"), F.kll_merge_agg_bigint("sketch").alias("sketch")
    )
    at = F.kll_sketch_get_quantile_bigint("sketch", F.lit([float(p) for p in points]))
    named = [F.get(F.col("_at"), F.lit(i)).alias(f"p{round(p * 100):d}") for i, p in enumerate(points)]
    return merged.withColumn("_at", at).select(*by, "days", "rows", *named)


def within_rank_error(
    df: DataFrame, percentiles: DataFrame, by: Sequence[str], value: str, points: Sequence[float], size: int = SIZE
) -> DataFrame:
    """``percentiles`` with ``within``: whether every point's rank among the rows of ``df`` is as near as stated."""
    names = [f"p{round(p * 100):d}" for p in points]
    met = df.filter(F.col(value).isNotNull()).join(percentiles, list(by))
    below = [F.count_if(F.col(value) < F.col(n)).alias(f"_lt_{n}") for n in names]
    upto = [F.count_if(F.col(value) <= F.col(n)).alias(f"_le_{n}") for n in names]
    ranks = met.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *below, *upto)
    slack = rank_error(size)

    def near(p: float, n: str) -> Column:
        return (F.col(f"_lt_{n}") <= (p + slack) * F.col("_n")) & (F.col(f"_le_{n}") >= (p - slack) * F.col("_n"))

    good = F.lit(True)
    for p, n in zip(points, names):
        good = good & near(p, n)
    return percentiles.join(ranks.select(*by, good.alias("within")), list(by))
