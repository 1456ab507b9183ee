"""Similarity search, context, citations, evaluation."""

from __future__ import annotations

import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerloom.operators import citations, evaluation, search

QUESTIONS = "qid long, user_id string, embedding array<double>, document_ids array<string>"


def test_single_search(chunk):
    store = chunk(("a", "d1", "u1", [1.0, 0.0]), ("b", "d2", "u1", [0.0, 1.0]), ("z", "d2", "u1", [0.0, 0.0]), ("x", "d1", "u2", [1.0, 0.0]))
    hits = search.vector_search(store, [1.0, 0.0], 9, "u1").collect()
    assert [(h["id"], h["score"]) for h in hits] == [("a", 1.0), ("b", 0.0), ("z", None)]
    assert hits[0]["company"] == "Acme" and "embedding" not in hits[0].asDict() and "user_id" not in hits[0].asDict()
    assert [h["id"] for h in search.vector_search(store, [1.0, 0.0], 9, "u1", ["d1"]).collect()] == ["a"]
    assert search.vector_search(store, [1.0, 0.0], 9, "u1", []).collect() == []
    assert [h["score"] for h in search.vector_search(store, [0.0, 0.0], 1, "u1").collect()] == [None]
    with pytest.raises(KeyError):
        search.vector_search(store, [1.0, 0.0], 1, "u1", colour="red")
    assert len(search.vector_search(store, [1.0, 0.0], 9, "u1", report_type="10-K").collect()) == 3


def brute_force(questions, chunks, k):
    """(qid, rank, id, score) by plain loops."""
    out = set()
    for qid, user, q, scope in questions:
        found = []
        for cid, doc, owner, c in chunks:
            if owner == user and (scope is None or doc in scope):
                lengths = np.linalg.norm(q) * np.linalg.norm(c)
                found.append((cid, None if lengths == 0 else round(float(np.dot(q, c) / lengths), 6) + 0.0))
        found.sort(key=lambda f: (f[1] is None, -(f[1] or 0), f[0]))
        out |= {(qid, i + 1, f[0], f[1]) for i, f in enumerate(found[:k])}
    return out


def random_case(seed, skewed):
    rng = np.random.default_rng(seed)
    users = ["u1"] * 8 + ["u2", "u3"] if skewed else ["u1", "u2", "u3"]
    pick = lambda n: [users[i] for i in rng.integers(0, len(users), n)]
    vectors = rng.integers(-2, 3, (120, 4)).astype(float)  # many ties, some zero vectors
    chunks = [(f"c{i:03d}", f"d{i % 7}", u, v.tolist()) for i, (u, v) in enumerate(zip(pick(120), vectors))]
    asked = rng.integers(-2, 3, (25, 4)).astype(float)
    scopes = [None, [], ["d1", "d3"]]
    questions = [(i, u, v.tolist(), scopes[i % 3]) for i, (u, v) in enumerate(zip(pick(25), asked))]
    return questions, chunks


@pytest.mark.parametrize("skewed", [False, True])
@pytest.mark.parametrize("options", [{}, {"max_sent": 0, "v_block": 16, "q_block": 4}, {"max_sent": 0}])
def test_batch_search_equals_brute_force(spark, chunk, skewed, options):
    questions, chunks = random_case(7, skewed)
    df = spark.createDataFrame(questions, QUESTIONS)
    hits = search.batch_vector_search(df, chunk(*chunks).repartition(5), 6, **options)
    got = [(h["qid"], h["rank"], h["id"], h["score"]) for h in hits.collect()]
    assert set(got) == brute_force(questions, chunks, 6) and len(got) == len(set(got))
    leaks = evaluation.audit_leaks(hits, df, chunk(*chunks))
    assert leaks.count() == 0


def test_wrong_vector_size_fails(spark, chunk):
    store = chunk(("a", "d", "u1", [1.0, 0.0, 0.0]))
    asked = spark.createDataFrame([(1, "u1", [1.0, 0.0], None)], QUESTIONS)
    with pytest.raises(Exception, match="must have 2 elements"):
        search.batch_vector_search(asked, store, 1).collect()


def test_rows_without_owner_or_vector_take_no_part(spark, chunk):
    store = chunk(("a", "d", "u1", [1.0, 0.0]), ("b", "d", None, [1.0, 0.0]), ("c", "d", "u1", None))
    asked = spark.createDataFrame([(1, "u1", [1.0, 0.0], None), (2, None, [1.0, 0.0], None), (3, "u1", None, None)], QUESTIONS)
    for options in ({}, {"max_sent": 0}):
        hits = search.batch_vector_search(asked, store, 5, **options)
        assert [(h["qid"], h["id"]) for h in hits.collect()] == [(1, "a")]
    assert search.batch_vector_search(asked.limit(0), store, 5).count() == 0


def test_all_lists_give_the_exact_answer(spark, chunk):
    questions, chunks = random_case(3, False)
    store = chunk(*chunks).select("id", "document_id", "user_id", "embedding")
    asked = spark.createDataFrame(questions, QUESTIONS)
    index = search.build_ivf(store, 4, max_iter=3)
    exact = search.batch_vector_search(asked, store, 5, payload=False)
    hits = search.ann_search(asked, index, 5, n_probe=4)
    scored = lambda df: {(r["qid"], r["id"], r["score"]) for r in df.filter("score is not null").collect()}
    assert scored(exact) == scored(hits)
    assert index.vectors.filter("list_id = -1").count() == sum(not any(c[3]) for c in chunks)
    recall = search.recall_at_k(search.ann_search(asked, index, 5, n_probe=1), exact).first()
    assert 0 < recall["recall"] <= 1


def test_policy(spark, chunk):
    store = chunk(*[(f"c{i}", "d", "u1", [1.0, i / 10]) for i in range(5)], ("far", "d", "u2", [0.0, 1.0]))
    asked = spark.createDataFrame(
        [(1, "u1", [1.0, 0.0], None), (2, "u2", [1.0, 1.5], None), (3, "u2", [1.0, 0.1], None), (4, "u3", [1.0, 0.0], None)], QUESTIONS
    )
    rows = search.retrieve_with_policy(asked, store, min_score=0.9, floor=0.5, k=2, k_wide=4).collect()
    got = sorted((r["qid"], r["id"], r["verdict"]) for r in rows if r["id"]) + [(r["qid"], r["verdict"]) for r in rows if not r["id"]]
    assert got[:3] == [(1, "c0", "ok"), (1, "c1", "ok"), (2, "far", "weak")]
    assert sorted(got[3:]) == [(3, "not_found"), (4, "not_found")]


def test_dimensions(spark, chunk):
    store = chunk(("a", "d1", "u1", [1.0, 0.0]), ("b", "d1", "u1", [0.0, 1.0]), ("c", "d2", "u1", [1.0, 1.0]))
    rows = search.retrieve_by_dimension({"risk": [1.0, 0.0], "guidance": [0.0, 1.0]}, store, ["d1", "d2"], 1).collect()
    assert {(r["dimension"], r["document_id"], r["id"]) for r in rows} == {
        ("risk", "d1", "a"), ("guidance", "d1", "b"), ("risk", "d2", "c"), ("guidance", "d2", "c")
    }


def test_context_blocks(spark):
    hits = spark.createDataFrame(
        [
            ("q", "a", "one", 0.9, "MD&A", 41, 43, "Acme", "FY2025"), ("q", "b", "two", 0.8, None, 7, 7, "Acme", None),
            ("q", "c", "three", 0.7, None, None, None, None, None), ("q", "d", "four", 0.7, "Notes", 1, None, None, None),
        ],
        "qid string, id string, text string, score double, section string, page_start int, page_end int, company string, fiscal_period string",
    )
    row = citations.build_context(hits).first()
    assert row["context"].split("\n\n") == [
        "[1] (Acme FY2025, MD&A, pp. 41–43): one", "[2] (Acme, p. 7): two", "[3]: three", "[4] (Notes, p. 1): four"
    ]


@pytest.mark.parametrize("run_length", [1, 3, 256])
def test_conversation_history(spark, run_length):
    turns = [(t, ["user", "assistant"][i % 2]) for i, t in enumerate([0, 1, 2, 5, 9, 10, 30, 31, 32])]
    df = spark.createDataFrame([("k", t, r, f"m{t}") for t, r in turns], "conversation_id string, turn long, role string, content string")
    rows = citations.conversation_context(df, 3, run_length).collect()
    got = {r["turn"]: [(m["role"], m["content"]) for m in r["history"]] for r in rows}
    names = {"user": "user", "assistant": "model"}
    want = {
        t: [(names[r2], f"m{t2}") for t2, r2 in turns[max(0, i - 3) : i]] for i, (t, r) in enumerate(turns) if r == "user"
    }
    assert got == want


GIVEN = "qid string, n int, chunk_id string, document_id string, page_start int, page_end int"


def given_blocks(spark, *numbers):
    return spark.createDataFrame([("q", n, f"c{n}", "d", n, n) for n in numbers], GIVEN)


def test_citations(spark):
    answers = spark.createDataFrame(
        [("q", "Up 10% [2], down [9] and [02] [0] [99999999999] [2]."), ("none", "No marker."), ("lost", "Only [1].")], "qid string, text string"
    )
    parsed = {(r["qid"], r["marker"]): (r["n"], r["position"], r["count"]) for r in citations.parse_citations(answers).collect()}
    assert parsed[("q", "2")] == (2, 1, 2) and parsed[("q", "99999999999")] == (None, 5, 1) and parsed[("q", "02")] == (2, 3, 1)
    rows = {r["qid"]: r for r in citations.validate_citations(answers, given_blocks(spark, 1, 2)).collect()}
    assert rows["q"]["text"] == "Up 10% [2], down and [02] [2]."
    assert [c["chunk_id"] for c in rows["q"]["citations"]] == ["c2"]
    assert sorted(rows["q"]["unknown"]) == ["0", "9", "99999999999"] and not rows["q"]["uncited"]
    assert rows["none"]["uncited"] and rows["none"]["citations"] == []
    assert rows["lost"]["text"] == "Only." and rows["lost"]["uncited"]


pieces = st.lists(st.sampled_from(["[1]", "[7]", "[", "]", "1", "7", " ", "a", "[12]"]), max_size=14).map("".join)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(pieces, min_size=8, max_size=8))
def test_validation_is_idempotent_and_leaves_no_unknown(spark, texts):
    answers = spark.createDataFrame([(str(i), t) for i, t in enumerate(["[1[7]2] x", *texts])], "qid string, text string")
    supplied = spark.createDataFrame([(str(i), 1, "c1", "d", 1, 1) for i in range(9)], GIVEN)
    once = citations.validate_citations(answers, supplied)
    twice = citations.validate_citations(once.select("qid", "text"), supplied)
    assert {(r["qid"], r["text"]) for r in once.collect()} == {(r["qid"], r["text"]) for r in twice.collect()}
    assert all(r["unknown"] == [] for r in twice.collect())


def repeated(text, known):
    """Take markers out one by one, the leftmost first, until none is left."""
    while found := next((m for m in re.finditer(r"\[([0-9]+)\]", text) if int(m[1]) not in known), None):
        start = found.start() - (text[: found.start()][-1:] == " ")
        text = text[:start] + text[found.end() :]
    return text


@given(st.lists(st.sampled_from(["[1]", "[7]", "[", "]", "1", "7", " ", "a", "[12]"]), max_size=20).map("".join))
def test_one_pass_takes_out_what_repetition_does(text):
    assert citations._without_unknown(text, frozenset({1})) == repeated(text, {1})


def test_many_brackets_take_one_pass():
    deep = "[" * 200_000 + "7" + "]" * 200_000
    assert citations._without_unknown(deep, frozenset()) == "[" * 199_999 + "]" * 199_999


def test_leaks_are_found(spark, chunk):
    store = chunk(("a", "d1", "u1", [1.0]), ("b", "d2", "u2", [1.0]))
    asked = spark.createDataFrame([(1, "u1", [1.0], ["d9"]), (2, "u1", [1.0], None)], QUESTIONS)
    hits = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (2, "zzz")], "qid long, id string")
    found = {(r["qid"], r["id"], r["problem"]) for r in evaluation.audit_leaks(hits, asked, store).collect()}
    assert found == {(1, "a", "outside_scope"), (2, "b", "foreign_chunk"), (2, "zzz", "unknown_chunk")}


def test_evaluation(spark):
    results = spark.createDataFrame(
        [("q1", ["a", "b", "c"], ["b"], False), ("q2", ["x"], [], True), ("q3", ["x"], ["x"], False)],
        "qid string, chunk_ids array<string>, cited_ids array<string>, refused boolean",
    )
    expected = spark.createDataFrame(
        [("q1", ["b", "z"], False), ("q2", ["m"], True), ("q3", ["y"], False), ("q4", ["y"], False)],
        "qid string, chunk_ids array<string>, must_refuse boolean",
    )
    rows = {r["qid"]: r for r in evaluation.evaluate(results, expected, 2).collect()}
    assert (rows["q1"]["hit"], rows["q1"]["recall"], rows["q1"]["reciprocal_rank"], rows["q1"]["passed"]) == (1.0, 0.5, 0.5, 1.0)
    assert rows["q2"]["hit"] is None and rows["q2"]["passed"] == 1.0
    assert rows["q4"]["passed"] == 0.0 and rows["q4"]["refusal_correct"] == 1.0
    assert rows[None]["is_total"] == 1 and rows[None]["passed"] == 0.5


def test_metric_evaluation(spark):
    schema = "document_id string, metric string, value double"
    got = spark.createDataFrame([("d1", "m", 100.0), ("d2", "m", 101.0), ("d3", "m", 150.0), ("d5", "m", 1.0)], schema)
    gold = spark.createDataFrame([("d1", "m", 100.0), ("d2", "m", 100.0), ("d3", "m", 100.0), ("d4", "m", 1.0), ("d5", "m", None)], schema)
    row = evaluation.evaluate_metrics(got, gold, 0.02).first().asDict()
    assert row == {"metric": "m", "exact": 1, "within_tolerance": 1, "wrong": 1, "missing": 1, "invented": 1, "agreed_null": 0}
