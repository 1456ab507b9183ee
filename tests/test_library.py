"""Sources, table maintenance, filters and checks on library rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators import access, maintenance, models
from ledgerloom.operators.search import vector_search
from ledgerloom.session import cut_lineage, rows_if_bounded, shared_dir
from ledgerloom.sources import index, objects, read_table, write_table


def ids(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


def test_typed_scan_reads_utc(spark, at):
    path = shared_dir(spark, "scan")
    rows = [(1, "fake", "fake-embedding", 16, at(0))]
    df = spark.createDataFrame(rows, "id bigint, embedding_provider string, embedding_model string, dimension int, updated_at timestamp_ntz")
    write_table(df, path, "index_meta")
    back = read_table(spark, path, "index_meta")
    assert dict(back.dtypes)["updated_at"] == "timestamp"
    assert back.first()["updated_at"] == at(0)
    with pytest.raises(KeyError):
        read_table(spark, path, "nothing")


def test_scan_and_validate_objects(spark, tmp_path):
    for key, data in {"u1/d1.pdf": b"%PDF-1.4 x", "u1/d2.pdf": b"GIF89a", "u2/d3.pdf": b"%PDF-" + b"0" * 2_000_000}.items():
        (tmp_path / key).parent.mkdir(exist_ok=True)
        (tmp_path / key).write_bytes(data)
    listed = objects.scan_objects(spark, str(tmp_path))
    assert "content" not in listed.columns
    assert {(r["user_id"], r["document_id"]) for r in listed.collect()} == {("u1", "d1"), ("u1", "d2"), ("u2", "d3")}
    pages = spark.createDataFrame([("u1/d1.pdf", 601)], "key string, page_count int")
    found = objects.validate_uploads(objects.scan_objects(spark, str(tmp_path), with_content=True), max_mb=1, page_counts=pages)
    assert {r["document_id"]: (r["ok"], r["reasons"]) for r in found.collect()} == {
        "d1": (False, ["too_many_pages"]), "d2": (False, ["bad_magic"]), "d3": (False, ["too_big"]),
    }


def test_validate_rejects_keys_outside_the_layout(spark):
    keys = ["../u/d.pdf", "/u/d.pdf", "u/../d.pdf", "d.pdf", "a/b/c.pdf", "u/d.pdf", None]
    df = spark.createDataFrame([(k, 10, bytearray(b"%PDF-1")) for k in keys], "key string, size long, content binary")
    assert {r["key"]: r["ok"] for r in objects.validate_uploads(df).collect()} == {k: k == "u/d.pdf" for k in keys}


def test_upsert_replaces_and_inserts(spark):
    target = spark.createDataFrame([("a", "old", 1), ("b", "keep", 1)], "id string, text string, n int")
    updates = spark.createDataFrame(
        [("a", "first", 2, 1), ("a", None, 3, 2), ("c", "new", 4, 1)], "id string, text string, n int, seq int"
    )
    once = maintenance.upsert(target, updates, order_by=["seq"])
    expected = {("a", None, 3), ("b", "keep", 1), ("c", "new", 4)}
    assert {tuple(r) for r in once.collect()} == expected
    assert {tuple(r) for r in maintenance.upsert(once, updates, order_by=["seq"]).collect()} == expected
    assert {tuple(r) for r in maintenance.upsert(target, updates.limit(0)).collect()} == {("a", "old", 1), ("b", "keep", 1)}


def test_overwritten_vector_is_found_once(chunk):
    store = maintenance.upsert(chunk(("a", "d1", "u1", [1.0, 0.0])), chunk(("a", "d1", "u1", [0.0, 1.0])))
    hits = vector_search(store, [0.0, 1.0], 10, "u1").collect()
    assert [(h["id"], h["score"]) for h in hits] == [("a", 1.0)]


def test_delete_by_document(spark, chunk):
    store = chunk(("a", "d1", "u1", [1.0, 0.0]), ("b", "d2", "u1", [1.0, 0.0]))
    assert ids(maintenance.delete_by_document(store, ["d1", "gone"])) == ["b"]
    assert ids(maintenance.delete_by_document(store, spark.createDataFrame([("d2",)], "x string"))) == ["a"]
    assert ids(maintenance.delete_by_document(store, [])) == ["a", "b"]


def test_cascade(spark):
    tables = {
        "users": spark.createDataFrame([("u1",), ("u2",)], "id string"),
        "documents": spark.createDataFrame([("d1", "u1"), ("d2", "u2"), ("d3", "u2")], "id string, user_id string"),
        "chunks": spark.createDataFrame([("c1", "d1"), ("c2", "d2"), ("c3", "d3")], "id string, document_id string"),
        "analyses": spark.createDataFrame(
            [("a1", "u1", ["d1"]), ("a2", "u2", ["d2"]), ("a3", "u2", ["d2", "d3"]), ("a4", "u2", [])],
            "id string, user_id string, document_ids array<string>",
        ),
        "conversations": spark.createDataFrame([("t1", "u1"), ("t2", "u2")], "id string, user_id string"),
        "messages": spark.createDataFrame([("m1", "t1"), ("m2", "t2")], "id string, conversation_id string"),
        "usage": spark.createDataFrame([(1, "u1"), (2, "u2")], "id long, user_id string"),
    }
    one = lambda v: spark.createDataFrame([(v,)], "id string")
    by_user = maintenance.cascade_delete(tables, users=one("u1"))
    assert {n: ids(df) for n, df in by_user.items()} == {
        "users": ["u2"], "documents": ["d2", "d3"], "chunks": ["c2", "c3"], "analyses": ["a2", "a3", "a4"],
        "conversations": ["t2"], "messages": ["m2"], "usage": [2],
    }
    by_doc = maintenance.cascade_delete(tables, documents=one("d2"))
    assert ids(by_doc["analyses"]) == ["a1", "a3", "a4"] and ids(by_doc["chunks"]) == ["c1", "c3"]
    assert ids(by_doc["usage"]) == [1, 2]


def test_reindex_publishes_whole_versions(spark):
    out = shared_dir(spark, "reindex")
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    for version, dim in ((1, 4), (2, 8)):
        index.reindex(chunks, lambda df, d=dim: models.hash_embed(df, dim=d), out, version, "fake", "fake-embedding", dim)
        assert {r[0] for r in index.read_published(spark, out).select(F.size("embedding")).collect()} == {dim}
    with pytest.raises(Exception, match="embedding size differs"):
        index.reindex(chunks, lambda df: models.hash_embed(df, dim=4), out, 3, "fake", "fake-embedding", 8)
    assert index.read_published(spark, out).select(F.size("embedding")).first()[0] == 8


def test_orphans(spark):
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "id string")
    objs = spark.createDataFrame([("d1",), ("d9",)], "document_id string")
    chunks = spark.createDataFrame([("c1", "d1"), ("c2", "d8")], "id string, document_id string")
    found = maintenance.find_orphans(one("d1", "d2"), objs, chunks, one("c1", "c7"))
    assert {tuple(r) for r in found.collect()} == {
        ("document_without_object", "d2"), ("object_without_document", "d9"),
        ("chunk_without_document", "c2"), ("vector_without_chunk", "c7"),
    }


def test_filters(chunk, spark):
    store = chunk(("a", "d1", "alice", [1.0, 0.0]), ("b", "d2", "bob", [1.0, 0.0]))
    assert ids(access.scope_to_user(store, "alice")) == ["a"]
    with pytest.raises(ValueError):
        access.scope_to_user(store, None)
    assert ids(access.apply_filters(store, {"document_ids": ["d1"], "company": None})) == ["a"]
    assert ids(access.apply_filters(store, {"document_ids": []})) == []
    assert ids(access.apply_filters(store, {"document_id": spark.createDataFrame([("d2",)], "d string")})) == ["b"]
    with pytest.raises(KeyError):
        access.apply_filters(store, {"colour": "red"})


def test_normalize_hits(spark):
    df = spark.createDataFrame([("", "x", -1, 3)], "section string, company string, page_start int, page_end int")
    assert tuple(access.normalize_hits(df).first()) == (None, "x", None, 3)


def test_duplicate_accounts(spark, at):
    users = spark.createDataFrame(
        [("1", "  Alice@Example.com ", at(5)), ("2", "ALICE@example.com", at(1)), ("3", "bob@example.com", at(0))],
        "id string, email string, created_at timestamp",
    )
    assert [tuple(r)[:3] for r in access.duplicate_accounts(users).collect()] == [("alice@example.com", 2, "2")]


def test_listing_pages_without_gaps(spark, at):
    docs = spark.createDataFrame(
        [(f"d{i}", "u1", at(i // 2), "ready") for i in range(7)] + [("x", "u2", at(9), "ready")],
        "id string, user_id string, created_at timestamp, status string",
    )
    seen, after = [], None
    while True:
        page = access.list_library(docs, "u1", 3, after).collect()
        if not page:
            break
        seen += [r["id"] for r in page]
        after = (page[-1]["created_at"], page[-1]["id"])
    assert seen == ["d6", "d4", "d5", "d2", "d3", "d0", "d1"]


def test_validate_metrics(spark):
    docs = spark.createDataFrame([("d", 10)], "id string, page_count int")
    rows = [("d", "a", None, None), ("d", "b", 1.0, None), ("d", "c", 1.0, 0), ("d", "e", 1.0, 10), ("z", "f", 1.0, 1)]
    metrics = spark.createDataFrame(rows, "document_id string, metric string, value double, source_page int")
    found = {r["metric"]: r["reason"] for r in access.validate_metrics(metrics, docs).collect()}
    assert found == {"b": "missing_page", "c": "page_out_of_range", "f": "unknown_document"}


def test_parse_structured(spark):
    schema = T.StructType(
        [T.StructField("revenue", T.DoubleType()), T.StructField("company", T.StringType(), False), T.StructField("source_page", T.IntegerType())]
    )
    good = '{"revenue": 123.4, "company": "Acme", "source_page": 42}'
    texts = [good, '{"revenue": null, "company": "Acme"}', "{not json", '{"revenue": "x", "company": "A"}', '{"revenue": 1.0}', None, '{"company": null}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, response_json string")
    rows = {r["id"]: r for r in access.parse_structured(df, "response_json", schema).collect()}
    assert [rows[i]["outcome"] for i in range(7)] == ["ok", "ok"] + ["invalid_response"] * 5
    assert tuple(rows[0]["parsed"]) == (123.4, "Acme", 42) and rows[2]["parsed"] is None


def test_size_check_and_checkpoint(spark):
    assert len(rows_if_bounded(spark.range(5), 5)) == 5
    assert rows_if_bounded(spark.range(6), 5) is None
    assert cut_lineage(spark.range(3)).count() == 3
