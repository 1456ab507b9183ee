"""Usage, cost, quotas and latency reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.core import floor_div
from ledgerloom.operators.quantiles import exact_percentiles
from ledgerloom.operators.slices import SLICE_ROWS
from ledgerloom.operators.temporal import latest_at, segments

DAY_MICROS = 86_400_000_000
# Default quotas per user.
DEFAULT_QUOTAS = {"documents": 100, "uploads_per_day": 20, "questions_per_day": 200}


def usage_summary(
    usage: DataFrame, by: Sequence[str] = ("kind", "provider", "model"), totals: str | None = None
) -> DataFrame:
    """Calls, tokens and cost by any of the ledger's columns and ``day``, with subtotals on request.

    ``totals`` is None, ``"rollup"`` or ``"cube"``; then ``grouping_id`` tells the subtotal rows.
    """
    if "day" in by:
        days = floor_div(F.unix_micros("created_at"), DAY_MICROS).cast("int")
        usage = usage.withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), days))
    group = {None: usage.groupBy, "rollup": usage.rollup, "cube": usage.cube}[totals]
    sums = [
        F.count(F.lit(1)).alias("calls"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.sum("cost_estimate").alias("cost"),
    ]
    if totals:
        sums.append(F.grouping_id().alias("grouping_id"))
    return group(*by).agg(*sums)


def estimate_cost(usage: DataFrame, prices: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Set ``cost_estimate`` from the price valid at call time; null for an unknown model or period.

    ``prices`` is (provider, model, usd_per_1k_in, usd_per_1k_out, valid_from, valid_to or null). No call is
    ever doubled; where periods overlap, the one that started last counts. Price periods become steps
    without overlaps, and each call looks up the step before it in one sort over both (:func:`latest_at`), so neither
    a long price history nor a model with most of the calls is held in one place.
    """
    model = ["provider", "model"]
    periods = prices.select(
        *model, F.unix_micros("valid_from").alias("_from"), F.unix_micros("valid_to").alias("_to"),
        "valid_from", "valid_to", "usd_per_1k_in", "usd_per_1k_out",
    )
    steps = segments(periods, model, ["valid_from", "valid_to", "usd_per_1k_in", "usd_per_1k_out"])
    found = latest_at(usage.withColumn("_us", F.unix_micros("created_at")), steps, model, slice_rows)
    price = F.col("_w.valid")
    cost = (
        F.col("tokens_in") * price["usd_per_1k_in"] + F.col("tokens_out") * price["usd_per_1k_out"]
    ) / F.lit(1000)
    return found.withColumn("cost_estimate", cost.cast("decimal(18,6)")).select(
        *[c for c in usage.columns if c != "cost_estimate"], "cost_estimate"
    )


def quota_status(
    users: DataFrame,
    documents: DataFrame,
    usage: DataFrame,
    as_of: object,
    defaults: Mapping[str, int] = DEFAULT_QUOTAS,
    question_kind: str = "llm",
) -> DataFrame:
    """Stored documents, uploads and questions on the UTC day of ``as_of`` against each user's limits.

    A limit of the user's own replaces the default. ``*_exceeded`` means the next one would be
    refused. Users without any activity are kept.
    """
    now = F.lit(as_of).cast("timestamp")
    day = floor_div(F.unix_micros(now), DAY_MICROS)
    today, tomorrow = F.timestamp_micros(day * DAY_MICROS), F.timestamp_micros((day + 1) * DAY_MICROS)

    def is_today(c: str) -> Column:
        return (F.col(c) >= today) & (F.col(c) < tomorrow)

    stored = documents.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(is_today("created_at")).alias("uploads_today")
    )
    asked = (
        usage.filter((F.col("kind") == question_kind) & is_today("created_at"))
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("questions_today"))
    )
    counts = ["documents", "uploads_today", "questions_today"]
    status = (
        users.select(
            F.col("id").alias("user_id"),
            F.coalesce("quota_documents", F.lit(defaults["documents"])).alias("documents_limit"),
            F.coalesce("quota_uploads_day", F.lit(defaults["uploads_per_day"])).alias("uploads_today_limit"),
            F.coalesce("quota_questions_day", F.lit(defaults["questions_per_day"])).alias("questions_today_limit"),
        )
        .join(stored, "user_id", "left")
        .join(asked, "user_id", "left")
        .fillna(0, counts)
    )
    return status.withColumns({f"{c}_exceeded": F.col(c) >= F.col(f"{c}_limit") for c in counts})


def latency_slo(access_log: DataFrame, targets: Mapping[str, int], default_target: int = 300) -> DataFrame:
    """Per route: requests, error rate, exact p50/p95/p99 of duration_ms, and p95 against its target.

    A route is method and path; ``targets`` maps a path to milliseconds.
    """
    route = ["method", "path"]
    totals = access_log.groupBy(*route).agg(
        F.count(F.lit(1)).alias("requests"),
        (F.count_if(F.col("status_code") >= 500) / F.count(F.lit(1))).alias("error_rate"),
    )
    points = exact_percentiles(access_log, route, "duration_ms", (0.5, 0.95, 0.99))
    target: Column = F.lit(default_target)
    for path, ms in targets.items():
        target = F.when(F.col("path") == path, ms).otherwise(target)
    return (
        totals.join(points, route, "left")
        .withColumn("target_ms", target)
        .withColumn("met", F.col("p95") < F.col("target_ms"))
    )
