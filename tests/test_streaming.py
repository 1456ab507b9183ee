"""Streams give what the batch operators give on the same rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ledgerloom import streaming
from ledgerloom.operators.limits import fixed_window
from ledgerloom.operators.stages import document_status
from ledgerloom.operators.usage import usage_summary
from ledgerloom.session import shared_dir


def feed(spark, schema, *batches, closed=None):
    """A stream that reads one file per batch, in order; ``closed`` is the column and time of a closing row."""
    src = shared_dir(spark, "feed")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    session = streaming.stream_session(spark)
    if closed:
        streaming.write_closing(spark, src, schema, *closed)
        schema = streaming.closable(schema)
    return session.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)


def test_usage_windows_and_late_rows(spark, at):
    schema = "created_at timestamp, user_id string, tokens_in int, tokens_out int, cost_estimate double"
    day = 86_400
    first = [(at(10), "a", 1, 0, 0.5), (at(20), "a", 2, 0, 0.5), (at(30), "b", 4, 0, 0.5), (at(3 * day), "a", 8, 0, 0.5)]
    # A batch drops what was late when the batch before it ended, so the late row comes in the third.
    late = [(at(40), "a", 100, 0, 9.0), (at(4 * day + 9000), "b", 1, 0, 0.5)]
    feeds = feed(spark, schema, first, [(at(3 * day + 5), "c", 1, 0, 0.5)], late)
    out = streaming.run_available(streaming.stream_usage(feeds), "usage")
    got = {(r["window_start"], r["user_id"]): (r["calls"], r["tokens_in"]) for r in spark.read.parquet(out).collect()}
    assert got.pop((at(3 * day), "c")) == (1, 1)
    assert got == {(at(0), "a"): (2, 3), (at(0), "b"): (1, 4), (at(3 * day), "a"): (1, 8)}
    batch = usage_summary(spark.createDataFrame(first, schema), ("user_id", "day"))
    assert {(r["user_id"], r["calls"], r["tokens_in"]) for r in batch.collect()} == {(u, *v) for (_, u), v in got.items()}


def test_closing_brings_out_every_window(spark, at):
    schema = "created_at timestamp, user_id string, tokens_in int, tokens_out int, cost_estimate double"
    rows = [(at(10), "a", 1, 0, 0.5), (at(150_000), None, 2, 0, 0.5)]
    stream = feed(spark, schema, rows, [(at(50_000), "a", 7, 0, 0.5)], [(at(5), "late", 9, 0, 0.5)], closed=("created_at", at(400_000)))
    out = streaming.run_available(streaming.stream_usage(stream, watermark="4 hours"), "usage")
    got = {(r["window_start"], r["user_id"]): (r["calls"], r["tokens_in"]) for r in spark.read.parquet(out).collect()}
    assert got == {(at(0), "a"): (2, 8), (at(86_400), None): (1, 2)}
    counts = streaming.late_rows(spark, out).agg(F.sum("late"), F.max_by("state_rows", "batch_id")).first()
    assert tuple(counts) == (1, 0)


def test_rate_limit_equals_batch(spark, at):
    """Whatever order and files requests come in, decisions are those of the batch; no state is left."""
    schema = "event_id long, k string, ts timestamp, n int"
    rows = [(i, ["a", "b", None][i % 3], at(i * 7 % 400 + i % 5), None if i % 4 else i) for i in range(90)]
    rows += [((1 << 60) + i, "a", at(200), None) for i in range(6)]
    mixed = rows[:]
    random.Random(3).shuffle(mixed)
    batch = fixed_window(spark.createDataFrame(rows, schema), ["k"], ttl_s=60, limit=5)
    columns = ["event_id", "k", "ts", "n", "window_start", "count", "allowed"]
    want = sorted(map(str, batch.select(columns).collect()))
    for files in ([mixed], [mixed[i::5] for i in range(5)], [sorted(rows, key=lambda r: r[2])[i : i + 20] for i in range(0, 100, 20)]):
        stream = feed(spark, schema, *files, closed=("ts", at(2000)))
        out = streaming.run_available(streaming.stream_rate_limit(stream, "k", 60, 5), "limits")
        assert sorted(map(str, spark.read.parquet(out).select(columns).collect())) == want
        left = streaming.late_rows(spark, out).agg(F.sum("late"), F.max_by("state_rows", "batch_id")).first()
        assert tuple(left) == (0, 0)


def test_documents_that_never_end_expire(spark, at):
    schema = "event_id long, document_id string, stage string, status string, error string, ts timestamp"
    one = [(1, "d", "store", "processing", None, at(0)), (2, "d", "store", "processing", None, at(50)), (3, "e", "store", "processing", None, at(0))]
    two = [(4, "d", "parse", "processing", None, at(400)), (5, "e", "store", "ready", None, at(20)), (6, "f", "store", "queued", None, at(30))]
    stream = feed(spark, schema, one, two, closed=("ts", at(10_000)))
    out = streaming.run_available(streaming.stream_progress(stream, expire_s=100), "stalled", "update")
    got = sorted((r["document_id"], r["ts"], r["event_id"] or 0, r["status"], r["previous_stage"] or "", r["previous_seconds"]) for r in spark.read.parquet(out).collect())
    assert got == [
        ("d", at(0), 1, "processing", "", None), ("d", at(150), 0, "stalled", "store", 150.0), ("d", at(400), 4, "processing", "", None),
        ("d", at(500), 0, "stalled", "parse", 100.0), ("e", at(0), 3, "processing", "", None), ("e", at(20), 5, "ready", "store", 20.0),
        ("f", at(30), 6, "queued", "", None), ("f", at(130), 0, "stalled", "store", 100.0),
    ]
    assert streaming.late_rows(spark, out).agg(F.max_by("state_rows", "batch_id")).first()[0] == 0


def test_progress(spark, at):
    schema = "event_id long, document_id string, stage string, status string, error string, ts timestamp"
    one = [(1, "d", "store", "processing", None, at(0)), (2, "d", "store", "processing", None, at(2)), (4, "e", "store", "processing", None, at(0))]
    two = [(3, "d", "metadata", "processing", None, at(5)), (5, "e", "store", "failed", "x", at(9)), (6, "e", "store", "processing", None, at(20))]
    out = spark.read.parquet(streaming.run_available(streaming.stream_progress(feed(spark, schema, one, two)), "progress", "update"))
    got = {r["event_id"]: (r["previous_stage"], r["previous_seconds"]) for r in out.collect()}
    assert got == {1: (None, None), 3: ("store", 5.0), 4: (None, None), 5: ("store", 9.0), 6: (None, None)}
    newest = out.groupBy("document_id").agg(F.max_by("stage", "event_id").alias("stage"))
    batch = document_status(spark.createDataFrame(one + two, schema)).select("document_id", "stage")
    assert sorted(newest.collect()) == sorted(batch.collect())


def test_job_dedupe(spark, at):
    schema = "job_id string, ts timestamp"
    stream = feed(spark, schema, [("a", at(0)), ("a", at(1)), ("b", at(1))], [("b", at(30)), ("c", at(31))])
    out = streaming.run_available(streaming.stream_dedupe_jobs(stream, "1 hour"), "jobs")
    assert sorted(r["job_id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_ingest_is_repeatable(spark):
    src, index = shared_dir(spark, "reports"), shared_dir(spark, "index")
    schema = "id string, user_id string, company string, fiscal_period string, report_type string, text string"

    def arrive(*rows):
        spark.createDataFrame([(i, "u", "Acme", "FY2025", "10-K", t) for i, t in rows], schema).coalesce(1).write.mode("append").parquet(src)

    session = streaming.stream_session(spark)

    def ingest():
        streaming.stream_ingest(session, src, index, schema).awaitTermination()
        return {(r["document_id"], r["text"]) for r in streaming.read_stream_index(spark, index).collect()}

    arrive(("d1", "old text"), ("d2", "other"))
    assert ingest() == {("d1", "old text"), ("d2", "other")}
    assert ingest() == {("d1", "old text"), ("d2", "other")}
    arrive(("d1", "new text"))
    assert ingest() == {("d1", "new text"), ("d2", "other")}
    row = streaming.read_stream_index(spark, index).first()
    assert len(row["embedding"]) == 16 and row["company"] == "Acme"


def test_progress_with_text_ids(spark, at):
    schema = "event_id string, document_id string, stage string, status string, error string, ts timestamp"
    rows = [("a", "d", "store", "processing", None, at(0)), ("b", "d", "metadata", "processing", None, at(5))]
    out = spark.read.parquet(streaming.run_available(streaming.stream_progress(feed(spark, schema, rows)), "progress-text", "update"))
    assert {r["event_id"]: r["previous_stage"] for r in out.collect()} == {"a": None, "b": "store"}


def test_many_keys_share_few_states(spark, at):
    """State rows grow with the groups of keys, not with the keys; null ids and null keys keep their rows."""
    from ledgerloom.streaming.stateful import GROUPS

    users = 3 * GROUPS
    schema = "event_id long, k long, ts timestamp"
    rows = [(i, i % users or None, at(i % 50)) for i in range(2 * users)]
    out = streaming.run_available(streaming.stream_rate_limit(feed(spark, schema, rows, closed=("ts", at(9000))), "k", 60, 1), "limits")
    got = spark.read.parquet(out)
    assert got.count() == 2 * users and got.filter("allowed").count() == users and got.filter("k is null").count() == 2
    assert streaming.late_rows(spark, out).agg(F.max("state_rows")).first()[0] <= 3 * GROUPS
    schema = "event_id long, document_id long, stage string, status string, error string, ts timestamp"
    events = [(None if i == 5 else i, i or None, "store", "processing", None, at(0)) for i in range(users)]
    stream = feed(spark, schema, events, closed=("ts", at(9000)))
    out = streaming.run_available(streaming.stream_progress(stream, expire_s=100), "stalled", "update")
    got = spark.read.parquet(out)
    assert got.groupBy("status").count().filter(f"count = {users}").count() == 2
    assert got.filter("document_id is null").count() == 2 and got.filter("document_id = 5 and event_id is null").count() == 2
    assert streaming.late_rows(spark, out).agg(F.max("state_rows")).first()[0] <= 3 * GROUPS


def test_progress_keeps_events_without_a_time(spark, at):
    schema = "event_id long, document_id string, stage string, status string, error string, ts timestamp"
    rows = [(1, "d", "store", "processing", None, at(0)), (2, "d", "embed", "processing", None, None), (3, None, "store", "queued", None, at(1))]
    out = spark.read.parquet(streaming.run_available(streaming.stream_progress(feed(spark, schema, rows)), "progress-null", "update"))
    assert {(r["event_id"], r["document_id"], r["ts"], r["previous_stage"]) for r in out.collect()} == {(2, "d", None, None), (1, "d", at(0), "embed"), (3, None, at(1), None)}
