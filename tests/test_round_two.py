"""Cases in which rows were lost, moved or accepted silently."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.operators.compare import compare_many, missing_metrics
from ledgerloom.operators.limits import fixed_window, rate_limit
from ledgerloom.operators.maintenance import cascade_delete, upsert
from ledgerloom.operators.models import _call
from ledgerloom.operators.search import retrieve_by_dimension, vector_search
from ledgerloom.operators.text import tables_to_markdown
from ledgerloom.operators.topk import _candidates, _keep_best, _Questions
from ledgerloom.operators.usage import usage_summary
from ledgerloom.sources.objects import scan_objects, validate_uploads

METRIC = "document_id string, metric string, value double"


@pytest.mark.parametrize("slots", [[("c", 1, "a"), ("c", 6, "b")], [("c", 1, "a"), ("c", 1, "b")]])
def test_bad_slots_fail(spark, slots):
    metrics = spark.createDataFrame([("a", "revenue", 1.0), ("b", "revenue", 2.0)], METRIC)
    with pytest.raises(Exception, match="slot"):
        compare_many(metrics, spark.createDataFrame(slots, "comparison_id string, slot int, document_id string")).collect()


def test_absent_cells_and_line_breaks(spark):
    cells = [(1, 1, "A"), (1, 2, "B"), (1, 3, "C"), (2, 1, "x"), (2, 3, "z\nw")]
    df = spark.createDataFrame(
        [("d", 1, 1, r, c, v) for r, c, v in cells],
        "document_id string, page_no int, table_no int, row_no int, col_no int, value string",
    )
    assert tables_to_markdown(df).first()["markdown"] == "| A | B | C |\n| --- | --- | --- |\n| x |  | z w |"


def test_broken_analysis_is_missing(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "id string")
    analyses = spark.createDataFrame(
        [("metrics", ["a"], '{"revenue": null}'), ("metrics", ["b"], "{broken")],
        "type string, document_ids array<string>, result string",
    )
    assert [r["id"] for r in missing_metrics(docs, analyses).collect()] == ["b"]


def test_privacy_delete_needs_parents(spark):
    gone = spark.createDataFrame([("u",)], "id string")
    messages = spark.createDataFrame([("m", "c")], "id string, conversation_id string")
    with pytest.raises(ValueError, match="conversations"):
        cascade_delete({"messages": messages}, users=gone)
    vectors = spark.createDataFrame([("v", "d", "u"), ("w", "e", "x")], "id string, document_id string, user_id string")
    left = cascade_delete({"chunk_embeddings": vectors}, users=gone)["chunk_embeddings"]
    assert [r["id"] for r in left.collect()] == ["w"]


def test_days_are_utc_in_any_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        usage = spark.sql(
            "SELECT timestamp_micros(1704067200000000) AS created_at, 1 AS tokens_in, 1 AS tokens_out, 0.5 AS cost_estimate"
        )
        assert usage_summary(usage, ["day"]).first()["day"] == dt.date(2024, 1, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_any_exception_is_an_outcome():
    def fails(_):
        raise TimeoutError("slow")

    assert _call(fails, ("x",), 3, lambda s: None) == (None, "error", "TimeoutError: slow", 1)


def test_ties_are_cut_within_a_tile(spark):
    """Many equal vectors: the smallest ids win, whatever the order and the tile."""
    rng = np.random.default_rng(3)
    ids = rng.permutation(20_000)
    vectors = np.ones((len(ids), 4))
    vectors[ids == 15_000] = [1, 2, 3, 4]
    asked = _Questions(
        pa.table({"qid": [0, 1], "embedding": [[1.0, 2.0, 3.0, 4.0], [1.0, 1.0, 1.0, 1.0]], "document_ids": pa.array([None, None], pa.list_(pa.int64()))})
    )
    pieces = list(_candidates(asked, ids, None, vectors, 8, 6))
    assert max(map(len, pieces)) <= 2 * 8
    best = _keep_best(pieces, 8)
    assert best[best["q"] == 0]["id"].tolist() == [15_000, *range(7)]
    assert best[best["q"] == 1]["id"].tolist() == list(range(8))


def test_vectors_of_another_size_are_an_error(spark):
    rows = [("a", "d", "u", [1.0, 0.0]), ("b", "d", "u", [1.0])]
    chunks = spark.createDataFrame(rows, "id string, document_id string, user_id string, embedding array<double>")
    with pytest.raises(Exception, match="must have 2 elements"):
        vector_search(chunks, [1.0, 0.0], 2, "u").collect()
    with pytest.raises(Exception, match="must have 2 elements"):
        retrieve_by_dimension({"x": [1.0, 0.0]}, chunks, None, 2).collect()


def test_upsert_of_equal_versions_keeps_the_same_row(spark):
    target = spark.createDataFrame([("a", "old")], "id string, text string")
    updates = spark.createDataFrame([("a", f"new {i}") for i in range(50)], "id string, text string")
    kept = [upsert(target, updates.repartition(n)).collect() for n in (1, 3, 7)]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 1


def test_requests_without_a_time_stay(spark):
    rows = [(1, dt.datetime(2024, 1, 1)), (2, None), (3, dt.datetime(2024, 1, 1, 0, 0, 1))]
    df = spark.createDataFrame([(i, t, "1.1.1.1", "/x", "u") for i, t in rows], "event_id long, ts timestamp, ip string, path string, user_id string")
    got = {r["event_id"]: (r["count"], r["allowed"]) for r in fixed_window(df, ["ip"], limit=5).collect()}
    assert got == {1: (1, True), 2: (None, None), 3: (2, True)}
    decided = {r["event_id"]: r["decision"] for r in rate_limit(df).collect()}
    assert decided == {1: "allowed", 2: None, 3: "allowed"}
    assert {r["count"] for r in fixed_window(df.where("ts IS NULL"), ["ip"]).collect()} == {None}


def test_large_objects_are_listed_but_not_opened(spark, tmp_path):
    (tmp_path / "u").mkdir()
    (tmp_path / "u/small.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "u/large.pdf").write_bytes(b"%PDF-" + b"0" * 2_000_000)
    listed = scan_objects(spark, str(tmp_path), with_content=True, max_bytes=1 << 20)
    assert {r["document_id"]: r["content"] is None for r in listed.collect()} == {"small": False, "large": True}
    found = {r["document_id"]: r["reasons"] for r in validate_uploads(listed, max_mb=1).collect()}
    assert found == {"small": [], "large": ["too_big"]}
