"""Answers from question to stored rows: verdicts, refusals, unknown markers, calls made once."""

from __future__ import annotations

from ledgerloom.operators.models import ModelError
from ledgerloom.plans import NOT_FOUND, answer_questions


def test_answers_and_what_is_stored(spark, at, chunk):
    store = chunk(("a", "d1", "u1", [1.0, 0.0]), ("b", "d1", "u1", [0.9, 0.1]), ("c", "d2", "u1", [0.0, 1.0]), ("x", "d9", "u2", [1.0, 0.0]))
    asked = [
        (1, "c1", "u1", "good one", [1.0, 0.0], None, at(1)), (2, "c1", "u1", "refuse it", [1.0, 0.0], None, at(2)),
        (3, "c2", "u1", "nothing", [-1.0, -1.0], None, at(3)), (4, "c2", "u1", "empty scope", [1.0, 0.0], [], at(4)), (5, "c3", "u9", "no library", [1.0, 0.0], None, at(5)),
    ]
    questions = spark.createDataFrame(asked, "qid long, conversation_id string, user_id string, text string, embedding array<float>, document_ids array<string>, asked_at timestamp")
    history = spark.createDataFrame([(1, "before")], "qid long, history string")
    calls = spark.sparkContext.accumulator(0)

    def model(question, said, context):
        calls.add(1)
        if question.startswith("refuse"):
            raise ModelError("refusal", code=422)
        assert "d9" not in context and context.startswith("[1] (Acme FY2025, MD&A, pp. 1–2): text for a")
        return f"{said or 'none'}: yes [1] and [2] or [7]."

    made = answer_questions(questions, store, model, 0.5, 0.1, "p", "m", history=history, k=2, k_wide=3)
    answers = {r["qid"]: r for r in made.answers.collect()}
    assert {q: (r["verdict"], r["outcome"], r["calls"]) for q, r in answers.items()} == {
        1: ("ok", "ok", 1), 2: ("ok", "refusal", 1), 3: ("not_found", "not_found", 0), 4: ("not_found", "not_found", 0), 5: ("not_found", "not_found", 0)
    }
    assert answers[1]["text"] == "before: yes [1] and [2] or." and [c["chunk_id"] for c in answers[1]["citations"]] == ["a", "b"]
    assert answers[1]["unknown"] == ["7"] and answers[2]["text"] is None and answers[3]["text"] == NOT_FOUND and answers[3]["uncited"]
    messages = {(r["conversation_id"], r["role"], r["content"]) for r in made.messages.collect()}
    assert messages == {
        ("c1", "user", "good one"), ("c1", "assistant", "before: yes [1] and [2] or."), ("c1", "user", "refuse it"), ("c2", "user", "nothing"),
        ("c2", "assistant", NOT_FOUND), ("c2", "user", "empty scope"), ("c3", "user", "no library"), ("c3", "assistant", NOT_FOUND),
    }
    assert made.messages.select("id").distinct().count() == made.messages.count() == 9
    usage = made.usage.collect()
    assert {(r["user_id"], r["kind"], r["provider"], r["model"], r["tokens_out"]) for r in usage} == {("u1", "llm", "p", "m", 7), ("u1", "llm", "p", "m", 0)}
    assert calls.value == 2
