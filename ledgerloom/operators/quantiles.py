"""Exact percentiles that never bring one group's values together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_percentiles(
    df: DataFrame, by: Sequence[str], value: str, points: Sequence[float]
) -> DataFrame:
    """One column ``p50``, ``p95``, ... per point for every group; linear between neighbours.

    ``value`` is a non-negative whole number. Equal values are counted before the first shuffle. A
    coarse histogram with steps of about one percent finds the step that holds each wanted rank,
    and only the distinct values of those steps are ordered.
    """
    by = list(by)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("bigint").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_step", F.floor(F.log2(F.col("_v") + 1.0) * 64).cast("int"))
    )
    running = Window.partitionBy(*by).orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    steps = (
        counts.groupBy(*by, "_step")
        .agg(F.sum("_n").alias("_in_step"))
        .withColumn("_upto", F.sum("_in_step").over(running))
        .withColumn("_all", F.sum("_in_step").over(Window.partitionBy(*by)))
    )
    position = F.col("_p") * (F.col("_all") - 1)
    wanted = (
        steps.withColumn("_p", F.explode(F.lit([float(p) for p in points])))
        .withColumn("_frac", position - F.floor(position))
        .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor(position), F.ceil(position)))))
        .filter((F.col("_rank") >= F.col("_upto") - F.col("_in_step")) & (F.col("_rank") < F.col("_upto")))
        .withColumn("_low", F.col("_rank") == F.floor(position))
        .select(*by, "_step", "_p", "_frac", "_low", (F.col("_rank") - F.col("_upto") + F.col("_in_step")).alias("_nth"))
    )
    in_step = Window.partitionBy(*by, "_step").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    needed = counts.join(wanted.select(*by, "_step").distinct(), [*by, "_step"], "left_semi")
    ordered = needed.withColumn("_end", F.sum("_n").over(in_step))
    picked = ordered.join(wanted, [*by, "_step"]).filter(
        (F.col("_nth") < F.col("_end")) & (F.col("_nth") >= F.col("_end") - F.col("_n"))
    )

    def point(p: float) -> F.Column:
        here = F.col("_p") == float(p)
        low = F.max(F.when(here & F.col("_low"), F.col("_v")))
        high = F.max(F.when(here & ~F.col("_low"), F.col("_v")))
        frac = F.max(F.when(here, F.col("_frac")))
        return (low + F.coalesce((high - low) * frac, F.lit(0.0))).alias(f"p{round(p * 100):d}")

    return picked.groupBy(*by).agg(*[point(p) for p in points])
