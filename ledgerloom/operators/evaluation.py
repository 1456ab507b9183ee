"""Audits and quality measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def audit_leaks(hits: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits that the asker must not see: another owner's chunk, or one outside the question's scope.

    ``hits`` is (qid, id), ``questions`` is (qid, user_id, document_ids), ``chunks`` is
    (id, user_id, document_id). Must be empty.
    """
    asked = questions.select("qid", F.col("user_id").alias("asker"), "document_ids")
    owned = chunks.select("id", F.col("user_id").alias("owner"), "document_id")
    joined = hits.select("qid", "id").join(asked, "qid", "left").join(owned, "id", "left")
    outside = F.col("document_ids").isNotNull() & ~F.coalesce(
        F.array_contains("document_ids", F.col("document_id")), F.lit(False)
    )
    problem = (
        F.when(F.col("owner").isNull(), "unknown_chunk")
        .when(F.col("asker").isNull(), "unknown_question")
        .when(F.col("owner") != F.col("asker"), "foreign_chunk")
        .when(outside, "outside_scope")
    )
    return joined.select("qid", "id", "asker", "owner", "document_id", problem.alias("problem")).filter(
        "problem is not null"
    )


def evaluate(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Retrieval and citation quality per question, with a total row (qid null).

    ``results`` is (qid, chunk_ids ranked, cited_ids, refused), ``expected`` is (qid, chunk_ids,
    must_refuse). A question passes when it refused as it should, or when it should answer and
    cited something expected and nothing else.
    """
    want = expected.select("qid", F.array_distinct("chunk_ids").alias("_want"), "must_refuse")
    got = results.select("qid", F.slice("chunk_ids", 1, k).alias("_got"), F.array_distinct("cited_ids").alias("_cited"), "refused")
    joined = want.join(got, "qid", "left").withColumns(
        {
            "_got": F.coalesce("_got", F.expr("cast(array() as array<string>)")),
            "_cited": F.coalesce("_cited", F.expr("cast(array() as array<string>)")),
            "refused": F.coalesce("refused", F.lit(False)),
        }
    )
    found = F.size(F.array_intersect("_got", "_want"))
    right = F.size(F.array_intersect("_cited", "_want"))
    first = F.array_min(F.filter(F.transform("_want", lambda w: F.array_position("_got", w)), lambda p: p > 0))
    answerable = ~F.col("must_refuse")
    per_question = joined.select(
        "qid",
        F.when(answerable, (found > 0).cast("double")).alias("hit"),
        F.when(answerable, F.try_divide(found, F.size("_want"))).alias("recall"),
        F.when(answerable, F.coalesce(F.try_divide(F.lit(1.0), first), F.lit(0.0))).alias("reciprocal_rank"),
        F.when(answerable, F.try_divide(right, F.size("_cited"))).alias("citation_precision"),
        F.when(answerable, F.try_divide(right, F.size("_want"))).alias("citation_recall"),
        (F.col("refused") == F.col("must_refuse")).cast("double").alias("refusal_correct"),
        F.when(F.col("must_refuse"), F.col("refused"))
        .otherwise(~F.col("refused") & (right > 0) & (right == F.size("_cited")))
        .cast("double")
        .alias("passed"),
    )
    measures = [c for c in per_question.columns if c != "qid"]
    return per_question.rollup("qid").agg(
        F.grouping("qid").cast("int").alias("is_total"), *[F.avg(c).alias(c) for c in measures]
    )


def evaluate_metrics(extracted: DataFrame, gold: DataFrame, rel_tol: float) -> DataFrame:
    """Per metric: exact, within tolerance, wrong, missing (gold only) and invented (no gold value).

    Both are (document_id, metric, value).
    """
    ours = extracted.select("document_id", "metric", F.col("value").alias("_got"))
    truth = gold.select("document_id", "metric", F.col("value").alias("_gold"))
    both = ours.join(truth, ["document_id", "metric"], "full_outer")
    got, want = F.col("_got"), F.col("_gold")
    verdict: Column = (
        F.when(got.isNull() & want.isNull(), "agreed_null")
        .when(want.isNull(), "invented")
        .when(got.isNull(), "missing")
        .when(got == want, "exact")
        .when(F.abs(got - want) <= F.abs(want) * F.lit(rel_tol), "within_tolerance")
        .otherwise("wrong")
    )
    kinds = ("exact", "within_tolerance", "wrong", "missing", "invented", "agreed_null")
    judged = both.select("metric", verdict.alias("_verdict"))
    return judged.groupBy("metric").agg(*[F.count_if(F.col("_verdict") == v).alias(v) for v in kinds])
