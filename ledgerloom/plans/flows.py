"""Ingest, question answering and comparison as lazy plans."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.citations import build_context, validate_citations
from ledgerloom.operators.compare import comparison_result, normalize_units, period_deltas
from ledgerloom.operators.layout import chunk_with_tables
from ledgerloom.operators.models import batch_generate, hash_embed
from ledgerloom.operators.search import DEFAULT_K, WIDE_K, batch_vector_search, retrieve_by_dimension, retrieve_with_policy
from ledgerloom.operators.text import OVERLAP_TOKENS, TARGET_TOKENS, chunk_documents, tables_to_markdown
from ledgerloom.session import cut_lineage


def ingest_documents(
    documents: DataFrame,
    dim: int = 16,
    target: int = TARGET_TOKENS,
    overlap: int = OVERLAP_TOKENS,
    cells: DataFrame | None = None,
) -> DataFrame:
    """Library documents with text to chunk vectors, without a shuffle.

    ``cells`` (as :func:`tables_to_markdown` takes them) are the documents' tables, which are chunked
    where they stand; tables and texts are then brought together by document.
    """
    facts = ("user_id", "company", "fiscal_period", "report_type")
    if cells is None:
        chunks = chunk_documents(documents, target=target, overlap=overlap, keep=facts)
    else:
        chunks = chunk_with_tables(documents, tables_to_markdown(cells), target=target, overlap=overlap, keep=facts)
    return hash_embed(chunks, dim=dim)


def answer_contexts(questions: DataFrame, index: DataFrame, k: int = 8, dim: int = 16) -> DataFrame:
    """Questions (qid, user_id, text, document_ids) to numbered context from the asker's library."""
    asked = hash_embed(questions, dim=dim).select("qid", "user_id", "embedding", "document_ids")
    return build_context(batch_vector_search(asked, index, k))


# What is said when the selected reports do not hold an answer (a fixed value).
NOT_FOUND = "not found in the selected reports"


@dataclass(frozen=True)
class Answers:
    """What answering leaves behind: ``answers`` per question, ``messages`` and ``usage`` rows for the library's tables."""

    answers: DataFrame
    messages: DataFrame
    usage: DataFrame


def answer_questions(
    questions: DataFrame,
    chunks: DataFrame,
    generate_fn: Callable[..., str],
    min_score: float,
    floor: float,
    provider: str,
    model: str,
    history: DataFrame | None = None,
    k: int = DEFAULT_K,
    k_wide: int = WIDE_K,
    **calls: object,
) -> Answers:
    """Questions to checked answers, with the rows that are stored for them.

    ``questions`` is (qid, conversation_id, user_id, text, embedding, document_ids, asked_at), ``chunks`` the index,
    ``history`` (qid, history) the turns before as one text. Retrieval follows the policy of :func:`retrieve_with_policy`; a
    question without a good enough hit is answered with ``NOT_FOUND`` and costs no call. ``generate_fn`` gets question,
    history and context; ``calls`` are options of :func:`batch_generate`. Markers of blocks that were not given are taken out.

    Answers are (qid, verdict, outcome, calls, text, citations, unknown, uncited); a failed call has no text and
    leaves the user's message only. Calls are made once: their results are written before they are used.
    """
    asked = questions.select("qid", "user_id", "embedding", "document_ids")
    policy = retrieve_with_policy(asked, chunks, min_score, floor, k, k_wide)
    payload = ["document_id", "text", "section", "page_start", "page_end", "company", "fiscal_period"]
    hits = cut_lineage(policy.join(chunks.select("id", *payload), "id", "left"))
    found = hits.filter("id is not null")
    verdicts = hits.select("qid", "verdict").distinct()
    prompts = questions.select("qid", "conversation_id", "user_id", F.col("text").alias("question"), "asked_at").join(verdicts, "qid")
    prompts = prompts.join(build_context(found).select("qid", "context"), "qid", "left")
    prompts = prompts.withColumn("history", F.lit("")) if history is None else prompts.join(history.select("qid", "history"), "qid", "left")
    sent = prompts.filter("verdict <> 'not_found'")
    made = cut_lineage(batch_generate(sent, ["question", "history", "context"], generate_fn, **calls).drop("context", "history"))
    supplied = found.select("qid", F.col("rank").alias("n"), F.col("id").cast("string").alias("chunk_id"), "document_id", "page_start", "page_end")
    checked = validate_citations(made.filter("outcome = 'ok'").select("qid", F.col("response").alias("text")), supplied)
    kept = ["qid", "conversation_id", "user_id", "question", "asked_at", "verdict", "outcome", "calls"]
    told = made.select(*kept).join(checked, "qid", "left")
    untold = prompts.filter("verdict = 'not_found'").select(
        *kept[:6], F.lit("not_found").alias("outcome"), F.lit(0).alias("calls"), F.lit(NOT_FOUND).alias("text"), F.lit(True).alias("uncited")
    )
    whole = told.unionByName(untold, allowMissingColumns=True)
    return Answers(
        whole.select("qid", "verdict", "outcome", "calls", "text", "citations", "unknown", "uncited"),
        _messages(whole),
        made.select(
            "user_id", F.lit("llm").alias("kind"), F.lit(provider).alias("provider"), F.lit(model).alias("model"),
            "tokens_in", "tokens_out", F.col("asked_at").alias("created_at"),
        ),
    )


def _messages(answered: DataFrame) -> DataFrame:
    """The user's message of every question, and the assistant's where there is an answer."""
    said = F.array(
        F.struct(F.lit("user").alias("role"), F.col("question").alias("content"), F.lit(None).cast(answered.schema["citations"].dataType).alias("citations")),
        F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content"), "citations"),
    )
    rows = answered.select("qid", "conversation_id", F.col("asked_at").alias("created_at"), F.inline(said)).filter("content is not null")
    return rows.select(
        F.sha2(F.concat_ws("|", F.col("qid").cast("string"), "role"), 256).alias("id"), "conversation_id", "role", "content", "citations", "created_at"
    )


def compare_reports(
    metrics: DataFrame,
    rates: DataFrame,
    chunks: DataFrame,
    dimensions: Mapping[str, Sequence[float]],
    ordinal: Column,
    lag_periods: int = 1,
    n: int = 2,
    together: bool = False,
) -> DataFrame:
    """Every report against its predecessor: computed deltas plus the best chunks per dimension.

    ``together``: the metrics lie by company already (:func:`period_deltas`).
    """
    deltas = period_deltas(normalize_units(metrics, rates), ordinal, lag_periods, together).withColumn(
        "comparison_id", F.col("document_id")
    )
    evidence = retrieve_by_dimension(dimensions, chunks, None, n).select(
        F.col("document_id").alias("comparison_id"), "document_id", F.col("id").alias("chunk_id"), "dimension", "score"
    )
    return comparison_result(deltas, evidence)
