"""Windowed usage and job de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.streaming.runner import watermarked


def stream_usage(usage: DataFrame, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Calls, tokens and cost per user and tumbling window; emitted once the watermark closes a window.

    Rows later than the watermark are dropped and counted (:func:`late_rows`). The last windows come out when the
    stream is closed (:func:`write_closing`).
    """
    return (
        watermarked(usage, "created_at", watermark)
        .groupBy(F.window("created_at", window), "user_id")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.sum("tokens_in").alias("tokens_in"),
            F.sum("tokens_out").alias("tokens_out"),
            F.sum("cost_estimate").alias("cost"),
        )
        .select(F.col("window.start").alias("window_start"), "user_id", "calls", "tokens_in", "tokens_out", "cost")
    )


def stream_dedupe_jobs(jobs: DataFrame, watermark: str = "1 day") -> DataFrame:
    """The first request for every job id; repeats while it is remembered are dropped."""
    return jobs.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["job_id"])
