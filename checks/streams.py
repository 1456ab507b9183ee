"""Streaming queries, each run over the driver tables as files of a stream."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.inputs import SCHEMAS, Inputs
from checks.registry import query
from ledgerloom import streaming
from ledgerloom.session import shared_dir


def _stream(t: Inputs, name: str) -> DataFrame:
    session = streaming.stream_session(t.spark)
    return session.readStream.schema(SCHEMAS[name]).option("pathGlobFilter", f"{name}.parquet").parquet(t.sf_dir)


def _closed_stream(t: Inputs, days: int, files: int) -> DataFrame:
    """All events, dealt to files by chance and read two by two of ``files``, and a closing row so many days after the last.

    A large table makes each of them several files, which are written and read together.
    """
    arriving = shared_dir(t.spark, "events")
    events = t.table("events")
    several = max(1, math.ceil(events.rdd.getNumPartitions() / files))
    events.repartition(files * several, F.xxhash64("event_id")).write.parquet(arriving)
    last = events.agg(F.max("ts")).first()[0]
    streaming.write_closing(t.spark, arriving, SCHEMAS["events"], "ts", last + dt.timedelta(days=days))
    session = streaming.stream_session(t.spark)
    stream = session.readStream.schema(streaming.closable(SCHEMAS["events"]))
    return (stream.option("maxFilesPerTrigger", 2 * several) if files > 1 else stream).parquet(arriving)


@query(
    "i1_stream_ingest",
    """SELECT id AS document_id, user_id, company, words FROM (
      SELECT id, user_id, company, CAST(len(list_filter(regexp_split_to_array(
        CASE WHEN id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels) THEN left(text, (length(text) + 1) // 2) ELSE text END, '\\s+'), lambda w: w <> '')) AS BIGINT) AS words
      FROM lib_documents) WHERE words > 0""",
)
def i1(t: Inputs) -> DataFrame:
    arriving, out = shared_dir(t.spark, "arriving"), shared_dir(t.spark, "ingest")
    session = streaming.stream_session(t.spark)
    # All documents arrive first; then the labelled ones come again, cut to half their length.
    documents = t.table("documents")
    labelled = documents.join(t.table("labels").select("doc_id"), "doc_id", "left_semi")
    shorter = labelled.withColumn("text", F.expr("left(text, int((length(text) + 1) div 2))"))
    for version in (documents, shorter):
        version.write.mode("append").parquet(arriving)
        streaming.stream_ingest(
            session, arriving, out, SCHEMAS["documents"], prepare=Inputs.as_library
        ).awaitTermination()
    index = streaming.read_stream_index(t.spark, out)
    # Windows of 800 words overlap by 100 within a group of five pages, so the words of a document
    # follow from its chunks.
    document = ["document_id", "user_id", "company"]
    per_group = index.groupBy(*document, F.floor((F.col("page_start") - 1) / 5)).agg(
        (F.sum("token_count") - 100 * (F.count(F.lit(1)) - 1)).alias("words")
    )
    return per_group.groupBy(*document).agg(F.sum("words").alias("words"))


@query(
    "i2_stream_usage",
    """SELECT epoch_us(date_trunc('day', created_at)) AS day_us, user_id, COUNT(*) AS calls, CAST(SUM(tokens_in) AS BIGINT) AS tokens_in, CAST(SUM(tokens_out) AS BIGINT) AS tokens_out,
      round(CAST(SUM(cost_estimate) AS DOUBLE), 6) AS cost FROM usage_log GROUP BY 1, 2""",
)
def i2(t: Inputs) -> DataFrame:
    totals = streaming.stream_usage(Inputs.as_usage(_closed_stream(t, 3, 1), "_closing"))
    rows = t.spark.read.parquet(streaming.run_available(totals, "usage"))
    return rows.select(
        F.unix_micros("window_start").alias("day_us"), "user_id", "calls", "tokens_in", "tokens_out",
        F.round(F.col("cost").cast("double"), 6).alias("cost"),
    )


@query(
    "i3_stream_rate_limit",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    r AS (SELECT event_id, user_id, rn, ts, ts AS start, 1 AS c FROM e WHERE rn = 1
      UNION ALL SELECT e.event_id, e.user_id, e.rn, e.ts, CASE WHEN e.ts >= r.start + INTERVAL 1 DAY THEN e.ts ELSE r.start END,
        CASE WHEN e.ts >= r.start + INTERVAL 1 DAY THEN 1 ELSE r.c + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
    SELECT event_id, user_id, epoch_us(start) AS start_us, CAST(c AS BIGINT) AS count, c <= 3 AS allowed FROM r""",
)
def i3(t: Inputs) -> DataFrame:
    # Shuffled over many files, so requests wait as long as any may still come before them.
    requests = _closed_stream(t, 500, 5).select("event_id", "user_id", "ts", "_closing")
    limited = streaming.stream_rate_limit(requests, "user_id", ttl_s=86_400, limit=3, watermark="400 days")
    rows = t.spark.read.parquet(streaming.run_available(limited, "limits"))
    return rows.select("event_id", "user_id", F.unix_micros("window_start").alias("start_us"), "count", "allowed")


@query(
    "i4_stream_progress",
    """WITH l AS (SELECT *, lag(stage) OVER w AS before, lag(status) OVER w AS status_before FROM stage_log WINDOW w AS (PARTITION BY document_id ORDER BY ts, event_id)),
    c AS (SELECT *, CASE WHEN status_before IN ('ready', 'failed') THEN NULL ELSE before END AS previous_stage FROM l),
    k AS (SELECT * FROM c WHERE previous_stage IS NULL OR stage <> previous_stage OR status IN ('ready', 'failed'))
    SELECT document_id, event_id, stage, status, previous_stage,
      CASE WHEN previous_stage IS NOT NULL THEN round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY document_id ORDER BY ts, event_id))) / 1e6, 3) END AS previous_seconds FROM k""",
)
def i4(t: Inputs) -> DataFrame:
    changes = streaming.stream_progress(Inputs.as_stages(_stream(t, "events")))
    rows = t.spark.read.parquet(streaming.run_available(changes, "progress", "update"))
    return rows.select(
        "document_id", "event_id", "stage", "status", "previous_stage", F.round("previous_seconds", 3).alias("previous_seconds")
    )


@query(
    "i4_stream_stalled",
    """WITH l AS (SELECT *, lag(stage) OVER w AS before, lag(status) OVER w AS status_before, lag(ts) OVER w AS heard, lead(ts) OVER w AS after FROM stage_log WINDOW w AS (PARTITION BY document_id ORDER BY ts, event_id)),
    c AS (SELECT *, CASE WHEN status_before NOT IN ('ready', 'failed') AND epoch_us(ts) - epoch_us(heard) <= 172800000000 THEN before END AS previous_stage FROM l),
    m AS (SELECT *, previous_stage IS NULL OR stage <> previous_stage OR status IN ('ready', 'failed') AS changes FROM c),
    k AS (SELECT *, max(CASE WHEN changes THEN ts END) OVER (PARTITION BY document_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM m),
    p AS (SELECT *, lag(since) OVER (PARTITION BY document_id ORDER BY ts, event_id) AS since_before FROM k)
    SELECT document_id, event_id, stage, status, previous_stage, CASE WHEN previous_stage IS NOT NULL THEN round((epoch_us(ts) - epoch_us(since_before)) / 1e6, 3) END AS previous_seconds FROM p WHERE changes
    UNION ALL SELECT document_id, NULL, stage, 'stalled', stage, round((epoch_us(ts) + 172800000000 - epoch_us(since)) / 1e6, 3) FROM p
    WHERE status NOT IN ('ready', 'failed') AND (after IS NULL OR epoch_us(after) - epoch_us(ts) > 172800000000)""",
)
def i4_stalled(t: Inputs) -> DataFrame:
    events = Inputs.as_stages(_closed_stream(t, 10, 1), "_closing")
    changes = streaming.stream_progress(events, expire_s=172_800)
    rows = t.spark.read.parquet(streaming.run_available(changes, "stalled", "update"))
    return rows.select(
        "document_id", "event_id", "stage", "status", "previous_stage", F.round("previous_seconds", 3).alias("previous_seconds")
    )


@query("i5_stream_dedupe_jobs", "SELECT DISTINCT 'job ' || CAST(user_id AS VARCHAR) || event_type AS job_id FROM events")
def i5(t: Inputs) -> DataFrame:
    jobs = _stream(t, "events").selectExpr("concat('job ', user_id, event_type) as job_id", "ts", "event_id")
    kept = streaming.stream_dedupe_jobs(jobs, watermark="60 days")
    return t.spark.read.parquet(streaming.run_available(kept, "jobs")).select("job_id")
