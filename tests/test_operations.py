"""Usage, limits, pipeline state, temporal joins."""

from __future__ import annotations

from decimal import Decimal as D

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerloom.operators import limits, stages, temporal, usage
from ledgerloom.operators.quantiles import exact_percentiles


def test_usage_summary_and_cost(spark, at):
    log = spark.createDataFrame(
        [(1, "u", "llm", "p", "m", 1000, 500, at(10)), (2, "u", "llm", "p", "m", 1000, 0, at(100)), (3, "u", "llm", "p", "x", 10, 0, at(10)), (4, "u", "llm", "p", "m", 9, 0, at(999))],
        "id long, user_id string, kind string, provider string, model string, tokens_in int, tokens_out int, created_at timestamp",
    )
    prices = spark.createDataFrame(
        [("p", "m", D("0.5"), D("1.0"), at(0), at(100)), ("p", "m", D("2.0"), D("1.0"), at(100), at(500)), ("p", "m", D("9.0"), D("9.0"), at(-50), at(5))],
        "provider string, model string, usd_per_1k_in decimal(10,6), usd_per_1k_out decimal(10,6), valid_from timestamp, valid_to timestamp",
    )
    costed = usage.estimate_cost(log, prices)
    assert {r["id"]: r["cost_estimate"] for r in costed.collect()} == {1: D("1.000000"), 2: D("2.000000"), 3: None, 4: None}
    rows = usage.usage_summary(costed, ("model",), "rollup").collect()
    assert {(r["model"], r["calls"], r["tokens_in"], r["cost"]) for r in rows} == {
        ("m", 3, 2009, D("3.000000")), ("x", 1, 10, None), (None, 4, 2019, D("3.000000"))
    }
    assert usage.usage_summary(costed, ("user_id", "day")).count() == 1


def test_quota(spark, at):
    users = spark.createDataFrame(
        [("a", 1, None, None), ("b", None, None, None)], "id string, quota_documents int, quota_uploads_day int, quota_questions_day int"
    )
    docs = spark.createDataFrame([("a", at(5))], "user_id string, created_at timestamp")
    log = spark.createDataFrame([("a", "llm", at(5)), ("a", "llm", at(90_000)), ("a", "embedding", at(5))], "user_id string, kind string, created_at timestamp")
    rows = {r["user_id"]: r for r in usage.quota_status(users, docs, log, "2025-01-01 12:00:00").collect()}
    a, b = rows["a"], rows["b"]
    assert (a["documents"], a["uploads_today"], a["questions_today"], a["documents_exceeded"], a["questions_today_exceeded"]) == (1, 1, 1, True, False)
    assert (b["documents"], b["documents_limit"], b["uploads_today_limit"], b["questions_today_limit"]) == (0, 100, 20, 200)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.integers(0, 5), st.integers(0, 100_000))), min_size=1, max_size=60))
def test_percentiles(spark, rows):
    df = spark.createDataFrame(rows, "k string, v long")
    for r in exact_percentiles(df, ["k"], "v", (0.0, 0.5, 0.95, 1.0)).collect():
        values = [v for k, v in rows if k == r["k"]]
        assert [r["p0"], r["p50"], r["p95"], r["p100"]] == pytest.approx(np.quantile(values, [0, 0.5, 0.95, 1]).tolist())


def test_latency(spark):
    log = spark.createDataFrame(
        [("GET", "/a", 200, 100), ("GET", "/a", 500, 400), ("POST", "/b", 200, 10)], "method string, path string, status_code int, duration_ms int"
    )
    rows = {r["path"]: r for r in usage.latency_slo(log, {"/a": 500}).collect()}
    assert (rows["/a"]["error_rate"], rows["/a"]["p50"], rows["/a"]["p95"], rows["/a"]["met"]) == (0.5, 250.0, 385.0, True)
    assert rows["/b"]["p99"] == 10.0 and rows["/b"]["target_ms"] == 300


def counted(requests, ttl):
    """The counter kept in plain Python: (event_id -> (window start, count))."""
    open_, out = {}, {}
    for event_id, key, t in sorted(requests, key=lambda r: (r[2], r[0])):
        start, n = open_.get(key, (None, 0))
        if start is None or t >= start + ttl:
            start, n = t, 0
        open_[key] = (start, n + 1)
        out[event_id] = (start, n + 1)
    return out


def windows(spark, at, requests, ttl, **options):
    df = spark.createDataFrame([(e, k, at(t)) for e, k, t in requests], "event_id long, k string, ts timestamp")
    rows = limits.fixed_window(df.repartition(3), ["k"], ttl_s=ttl, **options).collect()
    start = at(0)
    return {r["event_id"]: (round((r["window_start"] - start).total_seconds()), r["count"]) for r in rows}


def test_window_cases(spark, at):
    same_instant = [(i, "k", 7) for i in range(52)]
    assert [windows(spark, at, same_instant, 60)[i][1] for i in (0, 49, 50, 51)] == [1, 50, 51, 52]
    edge = [(1, "k", 0), (2, "k", 59), (3, "k", 60), (4, "k", 119), (5, "other", 60)]
    assert windows(spark, at, edge, 60) == {1: (0, 1), 2: (0, 2), 3: (60, 1), 4: (60, 2), 5: (60, 1)}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.sampled_from("hhhhab"), st.integers(-300, 3000)), min_size=1, max_size=150),
    st.integers(1, 400), st.sampled_from([2, 5, 30, 1000]),
)
def test_windows_equal_the_plain_counter(spark, at, rows, ttl, slice_rows):
    requests = [(i, k, t) for i, (k, t) in enumerate(rows)]
    assert windows(spark, at, requests, ttl, slice_rows=slice_rows) == counted(requests, ttl)


def test_dense_hot_key(spark, at):
    rng = np.random.default_rng(5)
    requests = [(i, "hot", int(t)) for i, t in enumerate(rng.integers(0, 40_000, 6000))] + [(10_000 + i, f"k{i}", i) for i in range(50)]
    assert windows(spark, at, requests, 37, slice_rows=300) == counted(requests, 37)


def test_rate_limit_by_address_then_user(spark, at):
    rows = [(i, at(i), "1.1.1.1", "/api/v1/auth/login", "u") for i in range(4)] + [(10 + i, at(i), "2.2.2.2", "/x", "u") for i in range(2)]
    rows += [(20, at(1), None, "/x", None), (21, at(50), "3.3.3.3", "/x", "u")]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, ip string, path string, user_id string")
    got = {r["event_id"]: (r["decision"], r["user_count"]) for r in limits.rate_limit(df, {"ip": 3, "auth_ip": 2, "user": 4}).collect()}
    assert got[2] == ("rejected_ip", None) and got[3] == ("rejected_ip", None) and got[20] == ("allowed", None)
    assert {got[e] for e in (0, 1, 10, 11)} == {("allowed", n) for n in (1, 2, 3, 4)} and got[21] == ("rejected_user", 5)


@pytest.fixture(scope="module")
def stage_log(spark, at):
    rows = [
        (1, "a", "store", "completed", None, at(0), 1), (2, "a", "metadata", "failed", "boom", at(10), 1), (3, "b", "store", "completed", None, at(0), 1),
        (4, "b", "metadata", "completed", None, at(5), 1), (5, "b", "metadata", "failed", "late", at(5), 3), (6, "c", "analyze", "ready", None, at(200_000), 1), (7, "c", "store", "completed", None, at(1), 1),
    ]
    return spark.createDataFrame(rows, "event_id long, document_id string, stage string, status string, error string, ts timestamp, attempt int")


def test_pipeline_state(stage_log):
    status = {r["document_id"]: (r["status"], r["stage"], r["error"]) for r in stages.document_status(stage_log).collect()}
    assert status == {"a": ("failed", "metadata", "boom"), "b": ("failed", "metadata", "late"), "c": ("ready", "analyze", None)}
    plan = {r["document_id"]: (r["resume_stage"], r["action"]) for r in stages.resume_plan(stage_log, max_attempts=3).collect()}
    assert plan == {"a": ("metadata", "retry"), "b": ("parse_chunk", "dead_letter")}
    times = {r["event_id"]: r["seconds"] for r in stages.stage_times(stage_log, slice_rows=1).collect()}
    assert times == {1: 10.0, 2: None, 3: 5.0, 4: 0.0, 5: None, 6: None, 7: 199_999.0}
    durations = {r["stage"]: (r["events"], r["failure_rate"], r["p50"]) for r in stages.stage_durations(stage_log).collect()}
    assert durations["metadata"] == (3, 2 / 3, 0.0) and durations["store"] == (3, 0.0, 10_000.0) and durations["analyze"] == (1, 0.0, None)


def test_queue_depth(spark, at):
    rows = [("enqueue", 0), ("enqueue", 10), ("finish", 20), ("enqueue", 3700), ("finish", 3750), ("finish", 3790)]
    df = spark.createDataFrame([(o, at(t)) for o, t in rows], "op string, ts timestamp")
    got = [(r["max_depth"], r["end_depth"]) for r in stages.queue_depth(df).orderBy("bucket_start").collect()]
    assert got == [(2, 1), (2, 0)]


def test_outcomes_and_backoff(spark):
    rows = [("r1", 0, 429, None), ("r1", 1, 200, "STOP"), ("r2", 0, 200, "safety"), ("r3", 0, 400, None)] + [("r4", i, 503, None) for i in range(6)]
    log = spark.createDataFrame(rows, "request_id string, attempt int, status_code int, finish_reason string")
    judged = {(r["request_id"], r["attempt"]): (r["outcome"], r["http_status"], r["retryable"]) for r in stages.classify_calls(log).collect()}
    assert judged[("r1", 0)] == ("rate_limited", 429, True) and judged[("r2", 0)] == ("refusal", 422, False) and judged[("r3", 0)] == ("unavailable", 503, False)
    report = {r["request_id"]: (r["calls"], r["recovered"], r["exhausted"]) for r in stages.retry_analysis(log).collect()}
    assert report == {"r1": (2, True, False), "r2": (1, False, False), "r3": (1, False, False), "r4": (6, False, True)}
    tries = spark.createDataFrame([(i, 0.0) for i in range(7)] + [(1, 7.5), (2, None)], "attempt int, retry_after double")
    delays = [r["delay_s"] for r in stages.backoff_schedule(tries).collect()]
    assert delays == [1.0, 2.0, 4.0, 8.0, 16.0, None, None, 7.5, 4.0]


def visible(writes, key, t):
    """What the cache shows at ``t``, by plain rules."""
    past = [(w[1], i, w) for i, w in enumerate(writes) if w[0] == key and w[1] <= t]
    if not past:
        return None
    _, ts, op, value, ttl = max(past)[2]
    return value if op == "set" and (ttl is None or t < ts + ttl) else None


def lookup(spark, at, reads, writes, slice_rows):
    w = spark.createDataFrame([(k, at(t), op, v, ttl, i) for i, (k, t, op, v, ttl) in enumerate(writes)], "key string, ts timestamp, op string, value string, ttl_s int, n int")
    r = spark.createDataFrame([(k, at(t), i) for i, (k, t) in enumerate(reads)], "key string, ts timestamp, read_id int")
    return {x["read_id"]: x["value"] for x in temporal.asof_ttl(r, w, seq="n", slice_rows=slice_rows).collect()}


def test_cache_cases(spark, at):
    writes = [("k", 10, "set", "v", None), ("e", 0, "set", "x", 0), ("t", 0, "set", "x", 5), ("d", 0, "set", "x", None), ("d", 5, "delete", None, None), ("o", 0, "set", "1", 2), ("o", 1, "set", "2", None)]
    reads = [("k", 9), ("k", 10), ("k", 9999), ("e", 0), ("t", 4), ("t", 5), ("d", 4), ("d", 5), ("o", 3), ("none", 1)]
    assert lookup(spark, at, reads, writes, 2) == {i: visible(writes, k, t) for i, (k, t) in enumerate(reads)}


ops = st.tuples(st.sampled_from("ab"), st.integers(0, 200), st.sampled_from(["set", "delete"]), st.sampled_from("xyz"), st.one_of(st.none(), st.integers(0, 90)))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ops, min_size=1, max_size=25), st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 250)), min_size=1, max_size=25), st.sampled_from([1, 4, 1000]))
def test_cache_equals_plain_rules(spark, at, writes, reads, slice_rows):
    assert lookup(spark, at, reads, writes, slice_rows) == {i: visible(writes, k, t) for i, (k, t) in enumerate(reads)}


def test_delivery(spark, at):
    subs = spark.createDataFrame([("s1", "doc-1", at(0), None), ("s2", "doc-1", at(5), at(9)), ("s3", "doc-2", at(0), None)], "subscriber string, channel string, from_ts timestamp, to_ts timestamp")
    events = spark.createDataFrame([("doc-1", at(5), 1), ("doc-1", at(9), 2), ("doc-2", at(1), 3), ("doc-3", at(1), 4), ("doc-2", at(-1), 5)], "channel string, ts timestamp, event_id int")
    got = {(r["subscriber"], r["event_id"]) for r in temporal.deliver_events(subs, events).collect()}
    assert got == {("s1", 1), ("s1", 2), ("s2", 1), ("s3", 3)}
