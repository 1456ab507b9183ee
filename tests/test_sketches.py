"""Sketched percentiles agree with exact ones within the stated bound, for any span of days."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.operators import sketches
from ledgerloom.operators.quantiles import exact_percentiles

POINTS = (0.5, 0.95, 0.99)


def test_merged_days_agree_with_exact_percentiles(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.lognormal(6, 1.5, 30_000), np.full(3000, 77)]).astype(int)
    rows = [(int(v), "a" if i % 3 else "b", i % 40) for i, v in enumerate(values)] + [(None, "a", 1), (5, None, 2)]
    df = spark.createDataFrame(rows, "v bigint, k string, d int").withColumn("ts", F.timestamp_seconds(F.col("d") * 86_400 + 7)).repartition(6)
    daily = sketches.daily_sketches(df, ["k"], "v", "ts").cache()
    assert daily.filter("k = 'a'").count() == 40 and daily.agg(F.sum("rows")).first()[0] == len(rows) - 1
    for days in (40, 7):
        some = df.filter(F.col("d") < days)
        found = sketches.sketched_percentiles(daily.filter(F.col("day") < days), ["k"], POINTS)
        held = sketches.within_rank_error(some, found, ["k"], "v", POINTS).collect()
        assert {r["k"] for r in held} == {"a", "b"} and all(r["within"] for r in held)
        exact = {r["k"]: r for r in exact_percentiles(some, ["k"], "v", POINTS).collect()}
        for r in held:
            mine = np.sort([v for v, k, d in rows if k == r["k"] and d < days and v is not None])
            for p in POINTS:
                low, high = (np.searchsorted(mine, r[f"p{round(p * 100)}"], side) / len(mine) for side in ("left", "right"))
                assert low - sketches.rank_error() <= p <= high + sketches.rank_error()
                assert np.isclose(exact[r["k"]][f"p{round(p * 100)}"], np.quantile(mine, p))


def test_wrong_percentiles_are_noticed(spark):
    df = spark.range(1000).select(F.lit("a").alias("k"), F.col("id").alias("v"))
    wrong = spark.createDataFrame([("a", 800)], "k string, p50 bigint")
    assert not sketches.within_rank_error(df, wrong, ["k"], "v", (0.5,)).first()["within"]
