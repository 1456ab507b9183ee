"""Pipeline state, queue depth, and the outcome of model calls, derived from event logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.core import floor_div
from ledgerloom.operators.quantiles import exact_percentiles
from ledgerloom.operators.retry import BASE_DELAY_S, MAX_DELAY_S, MAX_JITTER, MAX_RETRIES, RETRYABLE_CODES
from ledgerloom.operators.slices import SLICE_ROWS, TimeSlices
from ledgerloom.schemas import STAGE_ORDER
from ledgerloom.session import cut_lineage

# Which finish reasons are refusals, outcome codes.
REFUSAL_REASONS = ("SAFETY", "PROHIBITED_CONTENT", "BLOCKLIST", "SPII", "RECITATION")
OUTCOME_STATUS = {"rate_limited": 429, "unavailable": 503, "refusal": 422}


def _newest(columns: Sequence[str]) -> Column:
    return F.max(F.struct("ts", "event_id", *columns))


def document_status(stage_events: DataFrame) -> DataFrame:
    """Status, stage and error of every document's newest event."""
    cols = ["status", "stage", "error"]
    return stage_events.groupBy("document_id").agg(_newest(cols).alias("e")).select(
        "document_id", *[F.col(f"e.{c}") for c in cols], F.col("e.ts").alias("updated_at")
    )


def stage_times(stage_events: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Each event with ``seconds`` until the next event of its document (null for the last).

    A document's log is worked on in slices of at most ``slice_rows`` events; what follows a slice's last event is
    looked up in a table with one row per document and slice. Runs jobs that count rows.
    """
    timed = stage_events.withColumn("_us", F.unix_micros("ts"))
    sliced = TimeSlices(timed, ["document_id"], rows=slice_rows).add(timed)
    in_slice = Window.partitionBy("document_id", "_slice").orderBy("_us", "event_id")
    own = sliced.withColumn("_next", F.lead("_us").over(in_slice))
    per_doc = Window.partitionBy("document_id").orderBy("_slice")
    heads = sliced.groupBy("document_id", "_slice").agg(F.min("_us").alias("_head"))
    carry = heads.select("document_id", "_slice", F.lead("_head").over(per_doc).alias("_later"))
    micros = F.coalesce("_next", "_later") - F.col("_us")
    return own.join(carry, ["document_id", "_slice"], "left").select(*stage_events.columns, (micros / 1_000_000).alias("seconds"))


def stage_durations(stage_events: DataFrame, failed_status: str = "failed") -> DataFrame:
    """Per stage: events, share of failures, p50 and p95 of the time to the next event in ms.

    The times are written once, as counts and percentiles read them several times.
    """
    times = stage_times(stage_events).select("stage", "status", F.round(F.col("seconds") * 1000).cast("bigint").alias("_ms"))
    timed = cut_lineage(times)
    counts = timed.groupBy("stage").agg(
        F.count(F.lit(1)).alias("events"),
        F.count("_ms").alias("finished"),
        (F.count_if(F.col("status") == failed_status) / F.count(F.lit(1))).alias("failure_rate"),
    )
    return counts.join(exact_percentiles(timed, ["stage"], "_ms", (0.5, 0.95)), "stage", "left")


def resume_plan(
    stage_events: DataFrame,
    stage_order: Sequence[str] = STAGE_ORDER,
    max_attempts: int = 3,
    done_status: str = "completed",
    failed_status: str = "failed",
) -> DataFrame:
    """Documents whose newest event is a failure: the first stage not completed, and what to do.

    ``action`` is ``retry`` or, once ``attempts`` reaches the bound, ``dead_letter``. One aggregation
    per document; the set of stages done is bounded by the stage order.
    """
    order = F.lit(list(stage_order))
    per_doc = stage_events.groupBy("document_id").agg(
        _newest(["status", "error"]).alias("e"),
        F.max("attempt").alias("attempts"),
        F.collect_set(F.when(F.col("status") == done_status, F.col("stage"))).alias("_done"),
    )
    open_stages = F.filter(order, lambda s: ~F.array_contains("_done", s))
    return per_doc.filter(F.col("e.status") == failed_status).select(
        "document_id",
        F.get(open_stages, F.lit(0)).alias("resume_stage"),
        "attempts",
        F.col("e.error").alias("error"),
        F.when(F.col("attempts") >= max_attempts, "dead_letter").otherwise("retry").alias("action"),
    )


def queue_depth(job_events: DataFrame, bucket: str = "1 hour", fine: str = "1 minute") -> DataFrame:
    """Open jobs over time: per bucket the highest depth, with that it opens with, and the depth at its end.

    Every bucket from the first event's to the last event's has a row, also one without events.

    Running sums are kept within fine slices, then over the slices of a bucket, then over buckets;
    each level hands one row per slice to the next, so no task orders more than one slice's
    instants or one run of 1,000 buckets; the last window has one row per such run. Events at one
    instant count together; events without a time are left out.
    """
    change = F.when(F.col("op") == "enqueue", 1).when(F.col("op") == "finish", -1).otherwise(0)

    def fold(df: DataFrame, by: list[str], order: str) -> DataFrame:
        """Net change and highest running sum of consecutive (net, peak) rows."""
        w = Window.partitionBy(*by).orderBy(order)
        before = F.coalesce(F.sum("_net").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return df.withColumn("_at", before + F.col("_peak")).groupBy(*by).agg(
            F.max("_at").alias("_peak"), F.sum("_net").alias("_net")
        )

    instants = job_events.groupBy("ts").agg(F.sum(change).alias("_net")).withColumn("_peak", F.col("_net"))
    tagged = instants.withColumn("_bucket", F.window("ts", bucket)["start"]).withColumn(
        "_fine", F.window("ts", fine)["start"]
    )
    per_bucket = fold(fold(tagged, ["_bucket", "_fine"], "ts"), ["_bucket"], "_fine")
    step = F.expr(f"unix_micros(timestamp_micros(0L) + interval {bucket})")
    runs = per_bucket.withColumn("_us", F.unix_micros("_bucket"))
    runs = runs.withColumn("_run", floor_div(F.col("_us"), step * 1000))
    order = Window.orderBy("_run")
    carried = (
        runs.groupBy("_run")
        .agg(F.sum("_net").alias("_total"), F.min("_us").alias("_first"))
        .select(
            "_run",
            F.coalesce(F.sum("_total").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_carry"),
            F.lead("_first").over(order).alias("_next_run"),
        )
    )
    within = Window.partitionBy("_run").orderBy("_us")
    before = F.coalesce(F.sum("_net").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = runs.join(carried, "_run").select(
        "_us",
        (F.col("_carry") + before).alias("_start"),
        "_peak",
        "_net",
        F.coalesce(F.lead("_us").over(within), "_next_run", F.col("_us") + step).alias("_following"),
    )
    at_end = F.col("_start") + F.col("_net")
    # After its own bucket a depth lasts until the next bucket with events.
    filled = known.withColumn("_at", F.explode(F.sequence("_us", F.col("_following") - step, step)))
    highest = F.greatest("_start", F.col("_start") + F.col("_peak"))
    return filled.select(
        F.timestamp_micros("_at").alias("bucket_start"),
        F.when(F.col("_at") == F.col("_us"), highest).otherwise(at_end).alias("max_depth"),
        at_end.alias("end_depth"),
    )


def classify_calls(call_log: DataFrame) -> DataFrame:
    """Add outcome, the HTTP status shown to the caller, and whether a retry makes sense.

    ``call_log`` has status_code, finish_reason and optionally valid (false: the answer failed its
    schema check).
    """
    code = F.col("status_code")
    invalid = F.col("valid") == F.lit(False) if "valid" in call_log.columns else F.lit(False)
    outcome = (
        F.when(code == 429, "rate_limited")
        .when(code >= 400, "unavailable")
        .when(F.upper("finish_reason").isin(*REFUSAL_REASONS), "refusal")
        .when(invalid, "invalid_response")
        .otherwise("ok")
    )
    status: Column = F.lit(None).cast("int")
    for name, http in OUTCOME_STATUS.items():
        status = F.when(F.col("outcome") == name, http).otherwise(status)
    return (
        call_log.withColumn("outcome", outcome)
        .withColumn("http_status", status)
        .withColumn("retryable", F.coalesce(code.isin(*RETRYABLE_CODES), F.lit(False)))
    )


def backoff_schedule(attempts: DataFrame) -> DataFrame:
    """Add the delay after each failed attempt (numbered from 0): base, largest with jitter, give_up.

    A positive ``retry_after`` is used as it is; otherwise the delay doubles from 1 s up to 30 s.
    After five retries there is no further delay.
    """
    n = F.col("attempt")
    doubled = F.least(F.lit(MAX_DELAY_S), F.lit(BASE_DELAY_S) * F.pow(F.lit(2.0), F.least(n, F.lit(30))))
    delay = F.when(F.coalesce(F.col("retry_after"), F.lit(0.0)) > 0, F.col("retry_after")).otherwise(doubled)
    over = n >= MAX_RETRIES
    return attempts.withColumn("delay_s", F.when(~over, delay)).withColumn(
        "max_delay_s", F.col("delay_s") * (1 + MAX_JITTER)
    ).withColumn("give_up", over)


def retry_analysis(call_log: DataFrame) -> DataFrame:
    """Per request: calls made, final outcome, whether a retry saved it or the retries ran out.

    ``call_log`` is (request_id, attempt from 0, status_code, finish_reason, ...).
    """
    judged = classify_calls(call_log)
    last = F.max(F.struct("attempt", "outcome", "retryable"))
    per_request = judged.groupBy("request_id").agg(F.count(F.lit(1)).alias("calls"), last.alias("l"))
    failed = F.col("l.outcome").isin("rate_limited", "unavailable")
    return per_request.select(
        "request_id",
        "calls",
        F.col("l.outcome").alias("outcome"),
        ((F.col("calls") > 1) & ~failed).alias("recovered"),
        (failed & F.col("l.retryable") & (F.col("l.attempt") >= MAX_RETRIES)).alias("exhausted"),
    )
