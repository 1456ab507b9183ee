"""From raw documents to packed sequences: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontamination, language, near_dedup, packing, quality
from ledgerloom.llm.common import written
from ledgerloom.llm.queries import TOKENIZER, fold, table

# A document stays if its main language covers this share of its letters.
LANGUAGE_SHARE = 0.5


def filtered(docs: DataFrame, judge: Callable[[DataFrame, str, str, tuple[str, ...]], DataFrame], stays: F.Column) -> DataFrame:
    """Rows of ``docs`` for which ``stays`` holds on what ``judge`` adds, whatever the columns are called."""
    names = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*names.values())
    keep = tuple(n for c, n in names.items() if c != "doc_id")
    judged = judge(plain, names["doc_id"], names["text"], keep).where(stays)
    return judged.select(*(F.col(n).alias(c) for c, n in names.items()))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones; it learns from the labels of the training fold."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), fold(3) != 1)
    return filtered(docs, lambda d, i, t, k: quality.score_quality(d, model, i, t, k), F.col("predicted") == 1)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and one language for at least half of them."""
    model = language.fit_languages(docs, fold(4) != 2)
    return filtered(
        docs,
        lambda d, i, t, k: language.identify(d, model, id_col=i, text_col=t, keep=k, with_spans=False),
        (F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SHARE),
    )


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (runs of five words, 80 %), that with the smallest id.

    Each row stands for itself, whatever its id: rows that share an id but not a text are two documents,
    rows without an id come last. Rows without words are copies only if their ids and texts agree.
    """
    names = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    text = F.col(names["text"]).cast("string")
    rows = written(docs.toDF(*names.values()).withColumn("row", F.monotonically_increasing_id()), "rows")
    found = near_dedup.near_duplicates(rows, shingle=5, percent=80, id_col="row", text_col=names["text"])
    ids = rows.select("row", F.col(names["doc_id"]).alias("id"), F.sha2(text, 256).alias("content"))
    bare = F.col("n_shingles") == 0
    groups = [
        F.when(~bare, F.col("component_id")).alias("component"),
        F.when(bare, F.col("id")).alias("bare_id"),
        F.when(bare, F.col("content")).alias("bare_content"),
    ]
    order = F.struct(F.col("id").isNull().alias("without"), "id", "content", "row")
    first = found.join(ids, "row").groupBy(bare.alias("bare"), *groups).agg(F.min(order).alias("first"))
    kept = rows.join(first.select("first.row"), "row", "left_semi")
    return kept.select(*(F.col(n).alias(c) for c, n in names.items()))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    _, hit = decontamination.judged(docs, table(spark, sf_dir, "benchmark"))
    same = docs["doc_id"].eqNullSafe(hit["hit_doc"]) & (decontamination.content_of("text") == hit["hit_content"])
    return docs.join(hit.select("hit_doc", "hit_content"), same, "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths with their ids."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
# The classifiers and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage leaves is written to the shared folder for the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
