"""Pages, sections, chunks, metadata, embeddings, generation."""

from __future__ import annotations

import time

import hashlib
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from ledgerloom.functions import cosine_similarity, token_count
from ledgerloom.operators import models, text

REPORT = """Acme Corp.
Form 10-K
Management's Discussion and Analysis
Revenue grew 10%.
Costs declined.
RISK FACTORS
Rates may rise.
Consolidated Financial Statements
Notes to the Consolidated Financial Statements
Note 1"""


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "id string, text string")


def test_pages_and_sections(spark):
    lines = text.split_pages(docs(spark, REPORT), lines_per_page=4)
    assert [r["page_no"] for r in lines.orderBy("line_no").collect()] == [1] * 4 + [2] * 4 + [3] * 2
    found = text.detect_sections(lines).orderBy("line_no").collect()
    assert [r["section"] for r in found] == [None] * 2 + ["MD&A"] * 3 + ["Risk Factors"] * 2 + ["Financial Statements"] + ["Notes"] * 2
    assert [r["section_no"] for r in found] == [0, 0, 1, 1, 1, 2, 2, 3, 4, 4]


def test_page_separator(spark):
    rows = text.split_pages(docs(spark, "a\nb\fc"), page_sep="\f").collect()
    assert [(r["page_no"], r["line_no"], r["line"]) for r in rows] == [(1, 1, "a"), (1, 2, "b"), (2, 3, "c")]


def test_no_heading_falls_back_to_page_groups(spark):
    lines = text.split_pages(docs(spark, "\n".join("x" * 12)), lines_per_page=1)
    found = text.detect_sections(lines).orderBy("line_no").collect()
    assert [r["section_no"] for r in found] == [0] * 5 + [1] * 5 + [2] * 2
    assert {r["section"] for r in found} == {None}


@pytest.mark.parametrize(("n", "sizes"), [(0, []), (1, [1]), (800, [800]), (801, [800, 101]), (1500, [800, 800]), (1501, [800, 800, 101])])
def test_window_sizes(spark, n, sizes):
    one = docs(spark, "\n".join(f"w{i}" for i in range(n)))
    chunks = text.chunk_documents(one, lines_per_page=10_000).orderBy("chunk_index").collect()
    assert [c["token_count"] for c in chunks] == sizes
    assert [c["chunk_index"] for c in chunks] == list(range(len(sizes)))


def test_bad_overlap(spark):
    with pytest.raises(ValueError):
        text.chunk_documents(docs(spark, "a"), target=5, overlap=5)


line_text = st.lists(st.sampled_from(["alpha", "beta", "RISK FACTORS", "x y z", "", "  two  words "]), min_size=1, max_size=30)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(line_text, min_size=1, max_size=3), st.integers(2, 9), st.integers(0, 4))
def test_windows_cover_every_token_once_outside_overlaps(spark, texts, target, overlap):
    overlap = min(overlap, target - 1)
    source = docs(spark, *["\n".join(t) for t in texts])
    lines = text.detect_sections(text.split_pages(source, lines_per_page=3))
    wide = text.chunk_windows(lines, target, overlap).orderBy("document_id", "chunk_index").collect()
    narrow = text.chunk_documents(source, target=target, overlap=overlap, lines_per_page=3)
    assert narrow.select(*sorted(narrow.columns)).orderBy("document_id", "chunk_index").collect() == [
        r for r in text.chunk_windows(lines, target, overlap).select(*sorted(narrow.columns)).orderBy("document_id", "chunk_index").collect()
    ]
    sections = {}
    for r in lines.orderBy("line_no").collect():
        sections.setdefault((r["document_id"], r["section_no"]), []).extend(r["line"].split())
    rebuilt, at = [], iter(wide)
    for _key, tokens in sorted(sections.items()):
        got, n = [], len(tokens)
        while len(got) < n:
            words = next(at)["text"].split(" ")
            assert len(words) <= target and (not got or len(words) > overlap)
            got.extend(words if not got else words[overlap:])
        rebuilt.append(got == tokens)
    assert all(rebuilt) and next(at, None) is None


def test_markdown(spark):
    cells = spark.createDataFrame(
        [("d", 1, 1, r, c, v) for r, c, v in [(0, 0, "Year"), (0, 1, "Sales|net"), (1, 1, None), (1, 0, "2025")]],
        "document_id string, page_no int, table_no int, row_no int, col_no int, value string",
    )
    assert text.tables_to_markdown(cells).first()["markdown"] == "| Year | Sales\\|net |\n| --- | --- |\n| 2025 |  |"


def test_metadata_first_match_wins(spark):
    body = "Acme Corp.\nAnnual Report\nForm 10-K\nNYSE: ACME\nfiscal year ended December 31, 2025\nFY2024"
    found = text.detect_metadata(text.split_pages(docs(spark, body, "nothing here"))).orderBy("document_id").collect()
    first = found[0].asDict()
    assert first["report_type"] == "annual" and first["ticker"] == "ACME" and first["company"] == "Acme Corp."
    assert first["fiscal_period"] == "2025" and first["fiscal_year_end"] == "December 31"
    assert all(v is None for k, v in found[1].asDict().items() if k != "document_id")


def test_corrections(spark, at):
    documents = spark.createDataFrame([("d1", "Old", 1), ("d2", "Same", 2)], "id string, company string, page_count int")
    edits = spark.createDataFrame(
        [("d1", "company", "A", at(1)), ("d1", "company", "B", at(2)), ("d1", "company", None, at(3)), ("d1", "page_count", "9", at(1))],
        "document_id string, field string, value string, edited_at timestamp",
    )
    fixed = text.apply_corrections(documents, edits, ["company", "page_count"])
    assert {tuple(r) for r in fixed.collect()} == {("d1", "B", 9), ("d2", "Same", 2)}


def test_token_count_equals_str_split(spark):
    texts = ["", " a ", "a  b\tc\n", "α β　γ", "x\x1cy\x85z", " ", "é è"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(token_count("t")).collect()] == [len(t.split()) for t in texts]
    assert spark.createDataFrame([(None,)], "t string").select(token_count("t")).first()[0] == 0


def test_content_ref_ignores_names(spark, at):
    data = [("a.pdf", "u", 1, bytearray(b"pdf-bytes")), ("b.pdf", "u", 2, bytearray(b"pdf-bytes")), ("c.pdf", "v", 3, bytearray(b"pdf-bytes"))]
    df = spark.createDataFrame(data, "id string, user_id string, uploaded_at int, content binary")
    refs = {r["content_ref"] for r in text.content_ref(df, "content").collect()}
    assert refs == {"fake-file-" + hashlib.sha256(b"pdf-bytes").hexdigest()[:16]}
    assert sorted(r["id"] for r in text.dedupe_uploads(df).collect()) == ["a.pdf", "c.pdf"]


@pytest.mark.parametrize("dim", [1, 4, 8, 16, 33])
def test_hash_embedding(spark, dim):
    texts = ["revenue grew 10%", "net income increased", "net income increased", "", "naïve café 東京", "a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    jvm = [r["embedding"] for r in models.hash_embed(df, dim=dim).orderBy("id").collect()]
    plugged = [r["embedding"] for r in models.embed_batches(df, "text", models.HashModel(dim), batch_size=2).orderBy("id").collect()]
    model = models.HashModel(dim)
    for t, a, b in zip(texts, jvm, plugged):
        assert len(a) == dim and math.isclose(math.hypot(*a), 1.0)
        assert a == pytest.approx(model.embed_query(t), abs=1e-12) and b == pytest.approx(a, abs=1e-12)
    assert jvm[1] == jvm[2]


def test_wrong_model_output_fails(spark):
    class Short(models.HashModel):
        def embed_documents(self, texts):
            return [[0.0]] * len(texts)

    with pytest.raises(Exception, match="size is not"):
        models.embed_batches(docs(spark, "a"), "text", Short(4)).collect()
    assert models.embed_batches(docs(spark, "a").limit(0), "text", models.HashModel(4)).collect() == []


def test_embedding_space_guard(spark, at):
    schema = "id long, embedding_provider string, embedding_model string, dimension int, updated_at timestamp"
    empty = spark.createDataFrame([], schema)
    fresh = models.check_embedding_space(empty, "fake", "fake-embedding", 16)
    assert tuple(fresh.first())[1:4] == ("fake", "fake-embedding", 16)
    stored = spark.createDataFrame([(1, "other", "other-embedding", 3072, at(9)), (2, "fake", "fake-embedding", 16, at(1))], schema)
    assert models.check_embedding_space(stored, "fake", "fake-embedding", 16).count() == 1
    for wrong in (("fake", "fake-embedding", 32), ("fake", "other", 16), ("other", "other-embedding", 3072)):
        with pytest.raises(ValueError, match="embedding configuration changed"):
            models.check_embedding_space(stored, *wrong)
    with pytest.raises(Exception, match="does not fit"):
        models.require_dimension(spark.createDataFrame([([1.0],)], "embedding array<float>"), 2).collect()


def test_cosine_of_zero_vector_is_null(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine_similarity("a", "b")).collect()] == [1.0, None]


def test_generation_outcomes(spark):
    schema = T.StructType([T.StructField("company", T.StringType(), False), T.StructField("revenue", T.DoubleType())])

    def flaky(prompt):
        # State lives in the prompt's list below: one process runs the single partition.
        seen[prompt] = seen.get(prompt, 0) + 1
        if prompt == "busy" and seen[prompt] == 1:
            raise models.ModelError("rate_limited", code=429, retry_after=0.5)
        if prompt == "down":
            raise models.ModelError("unavailable", code=503)
        if prompt == "unsafe":
            raise models.ModelError("refusal", "declined")
        if prompt == "broken" or (prompt == "second" and seen[prompt] == 1):
            return "{"
        return '{"company": "Acme", "revenue": null}'

    seen: dict[str, int] = {}
    df = docs(spark, "fine", "busy", "down", "unsafe", "broken", "second").coalesce(1)
    rows = models.batch_generate(df, ["text"], flaky, schema=schema, max_retries=2, sleep=lambda s: None)
    found = {r["text"]: (r["outcome"], r["calls"]) for r in rows.collect()}
    assert found == {
        "fine": ("ok", 1), "busy": ("ok", 2), "down": ("unavailable", 3), "unsafe": ("refusal", 1),
        "broken": ("invalid_response", 2), "second": ("ok", 2),
    }


def test_answers_keep_their_order_and_callers_wait_together(spark):
    def slow(prompt):
        time.sleep(0.02 if int(prompt) % 3 == 0 else 0)
        return f"answer {prompt}"

    df = docs(spark, *[str(i) for i in range(60)])
    rows = models.batch_generate(df, ["text"], slow, concurrency=6).collect()
    assert {(r["text"], r["response"]) for r in rows} == {(str(i), f"answer {i}") for i in range(60)}
    waits, now = [], [100.0]
    pause = models._Pause(waits.append, lambda: now[0])
    pause.wait()
    pause.note(4.0)
    pause.note(1.0)
    pause.wait()
    now[0] = 103.0
    pause.wait()
    now[0] = 104.0
    pause.wait()
    assert waits == [4.0, 1.0]


def test_usage_rows(spark):
    rows = models.batch_generate(docs(spark, "two words", "one"), ["text"], lambda p: p + " more")
    usage = models.generation_usage(rows, "p", "m").first()
    assert tuple(usage) == ("llm", "p", "m", 3, 5)
    usage = models.embedding_usage(docs(spark, "two words", "one"), "text", models.HashModel(4)).first()
    assert (usage["kind"], usage["provider"], usage["tokens_in"]) == ("embedding", "fake", 3)


def test_spaces_of_many_indexes(spark):
    indexes = spark.createDataFrame([(i,) for i in range(4)], "n int")
    meta = spark.createDataFrame([(1, 1, "p", "m", 3), (2, 1, "p", "m", 3), (2, 2, "p", "m", 4), (3, 5, "p", None, 3)], "n int, id long, embedding_provider string, embedding_model string, dimension int")
    got = {r["n"]: r["verdict"] for r in models.space_verdicts(indexes, meta, ["n"], "p", "m", 3).collect()}
    assert got == {0: "recorded", 1: "kept", 2: "refused", 3: "refused"}
