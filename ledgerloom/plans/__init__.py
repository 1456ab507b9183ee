"""Whole flows put together from the operators."""

from ledgerloom.plans.flows import NOT_FOUND, Answers, answer_contexts, answer_questions, compare_reports, ingest_documents

__all__ = ["NOT_FOUND", "Answers", "answer_contexts", "answer_questions", "compare_reports", "ingest_documents"]
