"""Usage, quotas, limits, pipeline state and temporal joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.inputs import SQL_VIEWS, Inputs
from checks.registry import query
from ledgerloom.operators import limits, sketches, stages, temporal, usage
from ledgerloom.session import cut_lineage

DAY_S = 86_400


def _cost(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cost", F.round(F.col("cost").cast("double"), 6))


SUMS = """COUNT(*) AS calls, CAST(SUM(tokens_in) AS BIGINT) AS tokens_in, CAST(SUM(tokens_out) AS BIGINT) AS tokens_out,
  round(CAST(SUM(cost_estimate) AS DOUBLE), 6) AS cost"""


@query("g1_usage_by_day", f"SELECT user_id, strftime(created_at, '%Y-%m-%d') AS day, {SUMS} FROM usage_log GROUP BY 1, 2")
def g1(t: Inputs) -> DataFrame:
    rows = usage.usage_summary(t.usage_log, ("user_id", "day"))
    return _cost(rows).withColumn("day", F.col("day").cast("string"))


@query(
    "g1_usage_rollup",
    f"SELECT kind, provider, model, {SUMS}, CAST(grouping_id(kind, provider, model) AS BIGINT) AS grouping_id FROM usage_log GROUP BY ROLLUP (kind, provider, model)",
)
def g1_rollup(t: Inputs) -> DataFrame:
    return _cost(usage.usage_summary(t.usage_log, totals="rollup"))


@query(
    "g1_usage_cube",
    f"SELECT kind, provider, {SUMS}, CAST(grouping_id(kind, provider) AS BIGINT) AS grouping_id FROM usage_log GROUP BY CUBE (kind, provider)",
)
def g1_cube(t: Inputs) -> DataFrame:
    return _cost(usage.usage_summary(t.usage_log, ("kind", "provider"), totals="cube"))


# Each model's price changes with the days on which it was first asked for signups; one model has no price.
SQL_VIEWS["price_list"] = """
SELECT provider, model, CAST(0.01 * n AS DECIMAL(10,6)) AS price, created_day AS valid_from,
  lead(created_day) OVER (PARTITION BY provider, model ORDER BY created_day) AS valid_to
FROM (SELECT provider, model, date_trunc('day', created_at) AS created_day, COUNT(*) AS n FROM usage_log
  WHERE model <> 'error' GROUP BY ALL)"""


@query(
    "g2_estimate_cost",
    """SELECT u.id, round(CAST((tokens_in * price + tokens_out * price * 2) AS DOUBLE) / 1000, 5) AS cost_estimate
    FROM usage_log u LEFT JOIN price_list p ON p.provider = u.provider AND p.model = u.model AND p.valid_from <= u.created_at AND (p.valid_to IS NULL OR u.created_at < p.valid_to)""",
)
def g2(t: Inputs) -> DataFrame:
    days = (
        t.usage_log.filter("model <> 'error'")
        .groupBy("provider", "model", F.date_trunc("day", "created_at").alias("valid_from"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    prices = days.withColumn(
        "valid_to", F.expr("lead(valid_from) over (partition by provider, model order by valid_from)")
    ).selectExpr(
        "provider", "model", "cast(0.01BD * n as decimal(10,6)) as usd_per_1k_in", "cast(0.02BD * n as decimal(10,6)) as usd_per_1k_out",
        "cast(valid_from as timestamp) as valid_from", "cast(valid_to as timestamp) as valid_to",
    )
    rows = usage.estimate_cost(t.usage_log, prices)
    return rows.select("id", F.round(F.col("cost_estimate").cast("double"), 5).alias("cost_estimate"))


@query(
    "g3_quota_status",
    """WITH users AS (SELECT c_custkey, 'u' || CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 3 = 0 THEN 40 END AS q FROM customer),
    docs AS (SELECT user_id, COUNT(*) AS documents, count_if(created_at >= TIMESTAMP '2024-01-20' AND created_at < TIMESTAMP '2024-01-21') AS uploads_today FROM lib_documents GROUP BY user_id),
    asked AS (SELECT user_id, COUNT(*) AS questions_today FROM usage_log WHERE kind = 'llm' AND created_at >= TIMESTAMP '2024-01-20' AND created_at < TIMESTAMP '2024-01-21' GROUP BY user_id),
    s AS (SELECT u.id AS user_id, COALESCE(documents, 0) AS documents, COALESCE(q, 45) AS documents_limit, COALESCE(uploads_today, 0) AS uploads_today,
      COALESCE(questions_today, 0) AS questions_today FROM users u LEFT JOIN docs d ON d.user_id = u.id LEFT JOIN asked a ON a.user_id = u.id)
    SELECT user_id, documents, documents_limit, uploads_today, questions_today, documents >= documents_limit AS documents_exceeded,
      uploads_today >= 2 AS uploads_today_exceeded, questions_today >= 3 AS questions_today_exceeded FROM s""",
)
def g3(t: Inputs) -> DataFrame:
    users = t.table("customer").selectExpr(
        "concat('u', c_custkey) as id", "case when c_custkey % 3 = 0 then 40 end as quota_documents",
        "cast(null as int) as quota_uploads_day", "cast(null as int) as quota_questions_day",
    )
    limits_ = {"documents": 45, "uploads_per_day": 2, "questions_per_day": 3}
    rows = usage.quota_status(users, t.lib_documents, t.usage_log, "2024-01-20 15:00:00", limits_)
    return rows.select(
        "user_id", "documents", "documents_limit", "uploads_today", "questions_today",
        "documents_exceeded", "uploads_today_exceeded", "questions_today_exceeded",
    )


@query(
    "g4_fixed_window",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    r AS (SELECT event_id, user_id, rn, ts, ts AS start, 1 AS c FROM e WHERE rn = 1
      UNION ALL SELECT e.event_id, e.user_id, e.rn, e.ts, CASE WHEN e.ts >= r.start + INTERVAL 1 DAY THEN e.ts ELSE r.start END,
        CASE WHEN e.ts >= r.start + INTERVAL 1 DAY THEN 1 ELSE r.c + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
    SELECT event_id, user_id, epoch_us(start) AS start_us, CAST(c AS BIGINT) AS count, c <= 3 AS allowed FROM r""",
)
def g4(t: Inputs) -> DataFrame:
    requests = t.table("events").select("event_id", "user_id", "ts")
    rows = limits.fixed_window(requests, ["user_id"], ttl_s=DAY_S, limit=3, slice_rows=2000)
    return rows.select("event_id", "user_id", F.unix_micros("window_start").alias("start_us"), "count", "allowed")


SQL_VIEWS["ip_keys"] = """
SELECT event_id, ts, ip, user_id, CASE WHEN starts_with(path, '/api/v1/auth') THEN 'auth' ELSE 'all' END AS bucket FROM request_log"""


@query(
    "g5_rate_limit",
    """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY bucket, ip ORDER BY ts, event_id) AS rn FROM ip_keys),
    r AS (SELECT event_id, bucket, ip, user_id, ts, rn, ts AS start, 1 AS c FROM e WHERE rn = 1
      UNION ALL SELECT e.event_id, e.bucket, e.ip, e.user_id, e.ts, e.rn, CASE WHEN e.ts >= r.start + INTERVAL 1 DAY THEN e.ts ELSE r.start END,
        CASE WHEN e.ts >= r.start + INTERVAL 1 DAY THEN 1 ELSE r.c + 1 END FROM r JOIN e ON e.bucket = r.bucket AND e.ip = r.ip AND e.rn = r.rn + 1),
    d AS (SELECT *, c <= CASE bucket WHEN 'auth' THEN 5 ELSE 20 END AS ip_ok FROM r),
    u AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS un FROM d WHERE ip_ok AND user_id IS NOT NULL),
    v AS (SELECT event_id, user_id, ts, un, ts AS start, 1 AS c FROM u WHERE un = 1
      UNION ALL SELECT u.event_id, u.user_id, u.ts, u.un, CASE WHEN u.ts >= v.start + INTERVAL 1 DAY THEN u.ts ELSE v.start END,
        CASE WHEN u.ts >= v.start + INTERVAL 1 DAY THEN 1 ELSE v.c + 1 END FROM v JOIN u ON u.user_id = v.user_id AND u.un = v.un + 1)
    SELECT d.event_id, CAST(d.c AS BIGINT) AS ip_count, CAST(v.c AS BIGINT) AS user_count,
      CASE WHEN NOT ip_ok THEN 'rejected_ip' WHEN v.c > 2 THEN 'rejected_user' ELSE 'allowed' END AS decision
    FROM d LEFT JOIN v ON v.event_id = d.event_id""",
)
def g5(t: Inputs) -> DataFrame:
    rows = limits.rate_limit(t.request_log, {"ip": 20, "auth_ip": 5, "user": 2}, ttl_s=DAY_S)
    return rows.select("event_id", "ip_count", "user_count", "decision")


@query(
    "g6_latency_slo",
    """SELECT path, COUNT(*) AS requests, round(count_if(status_code >= 500) / COUNT(*), 6) AS error_rate,
      round(quantile_cont(ms, 0.5), 4) AS p50, round(quantile_cont(ms, 0.95), 4) AS p95, round(quantile_cont(ms, 0.99), 4) AS p99,
      quantile_cont(ms, 0.95) < CASE path WHEN '/api/v1/documents' THEN 6000 ELSE 300 END AS met
    FROM (SELECT r.path, CASE WHEN e.event_type = 'error' THEN 500 ELSE 200 END AS status_code, CAST(round(value * 100) AS BIGINT) AS ms
      FROM events e JOIN request_log r ON r.event_id = e.event_id) GROUP BY path""",
)
def g6(t: Inputs) -> DataFrame:
    log = t.table("events").selectExpr(
        "'GET' as method",
        "case when event_type = 'signup' then '/api/v1/auth/login' else '/api/v1/documents' end as path",
        "case when event_type = 'error' then 500 else 200 end as status_code",
        "cast(round(value * 100) as bigint) as duration_ms",
    )
    rows = usage.latency_slo(log, {"/api/v1/documents": 6000})
    return rows.select(
        "path", "requests", F.round("error_rate", 6).alias("error_rate"), *[F.round(p, 4).alias(p) for p in ("p50", "p95", "p99")], "met"
    )


# Latencies from daily sketches: the counts are exact, and the percentiles as near in rank as stated.
@query(
    "g6_latency_sketches",
    """SELECT path, COUNT(DISTINCT date_trunc('day', e.ts)) AS days, COUNT(*) AS requests, TRUE AS within
    FROM events e JOIN request_log r ON r.event_id = e.event_id GROUP BY path""",
)
def g6_sketches(t: Inputs) -> DataFrame:
    log = t.table("events").selectExpr(
        "case when event_type = 'signup' then '/api/v1/auth/login' else '/api/v1/documents' end as path", "cast(round(value * 100) as bigint) as ms", "ts",
    )
    points = (0.5, 0.95, 0.99)
    found = sketches.sketched_percentiles(sketches.daily_sketches(log, ["path"], "ms", "ts"), ["path"], points)
    held = sketches.within_rank_error(log, cut_lineage(found), ["path"], "ms", points)
    return held.select("path", "days", F.col("rows").alias("requests"), "within")


@query(
    "g8_stage_sketches",
    """WITH d AS (SELECT stage, ts, round((epoch_us(lead(ts) OVER (PARTITION BY document_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1000.0) AS ms FROM stage_log)
    SELECT stage, COUNT(DISTINCT date_trunc('day', ts)) AS days, COUNT(*) AS finished, TRUE AS within FROM d WHERE ms IS NOT NULL GROUP BY stage""",
)
def g8_sketches(t: Inputs) -> DataFrame:
    times = stages.stage_times(t.stage_log).select("stage", "ts", F.round(F.col("seconds") * 1000).cast("bigint").alias("ms"))
    timed, points = cut_lineage(times), (0.5, 0.95)
    found = sketches.sketched_percentiles(sketches.daily_sketches(timed, ["stage"], "ms", "ts"), ["stage"], points)
    held = sketches.within_rank_error(timed, cut_lineage(found), ["stage"], "ms", points)
    return held.select("stage", "days", F.col("rows").alias("finished"), "within")


@query(
    "g7_document_status",
    """SELECT document_id, status, stage, error, epoch_us(ts) AS updated_us FROM stage_log QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def g7(t: Inputs) -> DataFrame:
    rows = stages.document_status(t.stage_log)
    return rows.select("document_id", "status", "stage", "error", F.unix_micros("updated_at").alias("updated_us"))


@query(
    "g8_stage_durations",
    """WITH d AS (SELECT stage, status, round((epoch_us(lead(ts) OVER (PARTITION BY document_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1000.0) AS ms FROM stage_log)
    SELECT stage, COUNT(*) AS events, COUNT(ms) AS finished, round(count_if(status = 'failed') / COUNT(*), 6) AS failure_rate,
      round(quantile_cont(ms, 0.5), 2) AS p50, round(quantile_cont(ms, 0.95), 2) AS p95 FROM d GROUP BY stage""",
)
def g8(t: Inputs) -> DataFrame:
    rows = stages.stage_durations(t.stage_log)
    return rows.select(
        "stage", "events", "finished", F.round("failure_rate", 6).alias("failure_rate"), F.round("p50", 2).alias("p50"), F.round("p95", 2).alias("p95")
    )


@query(
    "g9_resume_plan",
    """WITH last AS (SELECT document_id, status, error FROM stage_log QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, event_id DESC) = 1),
    stage_order AS (SELECT unnest(['store', 'metadata', 'parse_chunk', 'embed_index', 'analyze']) AS stage, unnest([1, 2, 3, 4, 5]) AS pos),
    open AS (SELECT l.document_id, arg_min(o.stage, o.pos) AS resume_stage FROM last l, stage_order o
      WHERE NOT EXISTS (SELECT 1 FROM stage_log s WHERE s.document_id = l.document_id AND s.stage = o.stage AND s.status = 'completed') GROUP BY l.document_id)
    SELECT l.document_id, o.resume_stage, a.attempts, l.error, CASE WHEN a.attempts >= 4 THEN 'dead_letter' ELSE 'retry' END AS action
    FROM last l JOIN (SELECT document_id, MAX(attempt) AS attempts FROM stage_log GROUP BY document_id) a ON a.document_id = l.document_id
    LEFT JOIN open o ON o.document_id = l.document_id WHERE l.status = 'failed'""",
)
def g9(t: Inputs) -> DataFrame:
    return stages.resume_plan(t.stage_log, max_attempts=4)


@query(
    "g10_queue_depth",
    """WITH i AS (SELECT ts, SUM(CASE WHEN event_type IN ('signup', 'view') THEN 1 WHEN event_type IN ('click', 'purchase') THEN -1 ELSE 0 END) AS net FROM events GROUP BY ts),
    d AS (SELECT ts, SUM(net) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS depth FROM i),
    h AS (SELECT unnest(generate_series(date_trunc('hour', MIN(ts)), date_trunc('hour', MAX(ts)), INTERVAL 1 HOUR)) AS s FROM i),
    p AS (SELECT date_trunc('hour', ts) AS s, MAX(depth) AS peak FROM d GROUP BY 1),
    o AS (SELECT h.s, COALESCE(d.depth, 0) AS opening FROM h ASOF LEFT JOIN d ON h.s > d.ts),
    e AS (SELECT x.s, d.depth AS ending FROM (SELECT s, s + INTERVAL 1 HOUR AS upto FROM h) x ASOF LEFT JOIN d ON x.upto > d.ts)
    SELECT epoch_us(o.s) AS bucket_us, CAST(greatest(opening, peak) AS BIGINT) AS max_depth, CAST(ending AS BIGINT) AS end_depth
    FROM o JOIN e ON e.s = o.s LEFT JOIN p ON p.s = o.s""",
)
def g10(t: Inputs) -> DataFrame:
    jobs = t.table("events").selectExpr(
        "ts", "case when event_type in ('signup', 'view') then 'enqueue' when event_type in ('click', 'purchase') then 'finish' end as op"
    )
    return stages.queue_depth(jobs).select(F.unix_micros("bucket_start").alias("bucket_us"), "max_depth", "end_depth")


@query(
    "g11_classify_calls",
    """SELECT event_id, CASE WHEN status_code = 429 THEN 'rate_limited' WHEN status_code >= 400 THEN 'unavailable' WHEN finish_reason = 'SAFETY' THEN 'refusal' WHEN NOT valid THEN 'invalid_response' ELSE 'ok' END AS outcome,
      CASE WHEN status_code = 429 THEN 429 WHEN status_code >= 400 THEN 503 WHEN finish_reason = 'SAFETY' THEN 422 END AS http_status,
      status_code IN (429, 500, 502, 503, 504) AS retryable FROM call_log""",
)
def g11(t: Inputs) -> DataFrame:
    return stages.classify_calls(t.call_log).select("event_id", "outcome", "http_status", "retryable")


@query(
    "g12_backoff_schedule",
    """SELECT event_id, CASE WHEN attempt < 5 THEN CASE WHEN retry_after > 0 THEN retry_after ELSE least(30.0, 2.0 ** attempt) END END AS delay_s, attempt >= 5 AS give_up
    FROM (SELECT event_id, CAST(event_id % 8 AS INTEGER) AS attempt, retry_after FROM call_log)""",
)
def g12(t: Inputs) -> DataFrame:
    attempts = t.call_log.selectExpr("event_id", "cast(event_id % 8 as int) as attempt", "retry_after")
    return stages.backoff_schedule(attempts).select("event_id", "delay_s", "give_up")


@query(
    "g12_retry_analysis",
    """WITH j AS (SELECT request_id, attempt, CASE WHEN status_code = 429 THEN 'rate_limited' WHEN status_code >= 400 THEN 'unavailable' WHEN finish_reason = 'SAFETY' THEN 'refusal' WHEN NOT valid THEN 'invalid_response' ELSE 'ok' END AS outcome,
        status_code IN (429, 500, 502, 503, 504) AS retryable FROM (SELECT event_id // 7 AS request_id, CAST(event_id % 7 AS INTEGER) AS attempt, status_code, finish_reason, valid FROM call_log)),
    l AS (SELECT request_id, COUNT(*) AS calls, arg_max(outcome, attempt) AS outcome, arg_max(retryable, attempt) AS retryable, MAX(attempt) AS attempt FROM j GROUP BY request_id)
    SELECT request_id, calls, outcome, calls > 1 AND outcome NOT IN ('rate_limited', 'unavailable') AS recovered,
      outcome IN ('rate_limited', 'unavailable') AND retryable AND attempt >= 5 AS exhausted FROM l""",
)
def g12_analysis(t: Inputs) -> DataFrame:
    calls = t.call_log.withColumn("request_id", F.expr("event_id div 7")).withColumn("attempt", F.expr("cast(event_id % 7 as int)"))
    return stages.retry_analysis(calls)


@query(
    "h1_asof_ttl",
    """WITH w AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS key, ts AS wts, event_type, event_id AS w_id FROM events WHERE event_type IN ('purchase', 'error')),
    r AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS key, ts, event_id FROM events WHERE event_type = 'view')
    SELECT r.key, r.event_id, CASE WHEN w.event_type = 'purchase' AND (w.w_id % 4 = 0 OR r.ts < w.wts + INTERVAL 12 HOUR) THEN 'v' || CAST(w.w_id AS VARCHAR) END AS value
    FROM r ASOF LEFT JOIN w ON w.key = r.key AND r.ts >= w.wts""",
)
def h1(t: Inputs) -> DataFrame:
    events = t.table("events").withColumn("key", F.concat(F.lit("u"), "user_id"))
    writes = events.filter("event_type in ('purchase', 'error')").selectExpr(
        "key", "ts", "case when event_type = 'error' then 'delete' else 'set' end as op", "concat('v', event_id) as value",
        "case when event_id % 4 <> 0 then 43200 end as ttl_s",
    )
    reads = events.filter("event_type = 'view'").select("key", "ts", "event_id")
    return temporal.asof_ttl(reads, writes).select("key", "event_id", "value")


@query(
    "h2_deliver_events",
    """SELECT 's' || CAST(s.event_id AS VARCHAR) AS subscriber, e.event_id, 'd' || CAST(e.user_id AS VARCHAR) AS channel
    FROM events s JOIN events e ON e.user_id = s.user_id AND e.ts >= s.ts AND (s.event_id % 50 = 0 OR e.ts < s.ts + INTERVAL 2 DAY) WHERE s.event_type = 'signup'""",
)
def h2(t: Inputs) -> DataFrame:
    events = t.table("events").selectExpr("concat('d', user_id) as channel", "ts", "event_id")
    subscriptions = t.table("events").filter("event_type = 'signup'").selectExpr(
        "concat('s', event_id) as subscriber", "concat('d', user_id) as channel", "ts as from_ts",
        "case when event_id % 50 <> 0 then ts + interval 2 days end as to_ts",
    )
    return temporal.deliver_events(subscriptions, events).select("subscriber", "event_id", "channel")
