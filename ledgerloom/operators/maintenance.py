"""Keeping the library's tables right: upsert, delete, cascade, orphan report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.rows import keep_first


def latest(df: DataFrame, key: str | Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """The row with the highest ``order_by`` values for every key."""
    keys = [key] if isinstance(key, str) else list(key)
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    return keep_first(df, keys, [c.desc_nulls_last() for c in order])


def upsert(
    target: DataFrame, updates: DataFrame, key: str = "id", order_by: Sequence[str | Column] = ()
) -> DataFrame:
    """Insert new ids and replace every other column of existing ones; one row per id results.

    Several updates of one id: the highest ``order_by`` wins (columns of ``updates``, which may
    hold more columns than ``target``); among equals, and without ``order_by``, a hash of the row
    decides, so that every run keeps the same one. Target rows are only probed against the updated ids, so
    with few updates the target is not shuffled.
    """
    settled = F.xxhash64(*(c for c, kind in updates.dtypes if "map<" not in kind))
    newest = latest(updates, key, [*order_by, settled]).select(*target.columns)
    untouched = target.join(updates.select(key).distinct(), key, "left_anti").select(*target.columns)
    return untouched.unionByName(newest)


def delete_by_document(
    chunks: DataFrame, doc_ids: DataFrame | Sequence[object], column: str = "document_id"
) -> DataFrame:
    """Drop everything that belongs to the given documents; unknown ids are ignored."""
    if isinstance(doc_ids, DataFrame):
        ids = doc_ids.select(F.col(doc_ids.columns[0]).alias(column)).distinct()
        return chunks.join(ids, column, "left_anti").select(*chunks.columns)
    if not doc_ids:
        return chunks
    return chunks.filter(~F.coalesce(F.col(column).isin(list(doc_ids)), F.lit(False)))


def _without(df: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    return df.join(gone.select(F.col("id").alias(column)), column, "left_anti").select(*df.columns)


def _drop_fully_deleted(analyses: DataFrame, gone: DataFrame) -> DataFrame:
    """Keep an analysis while it refers to a document that stays, or to none at all."""
    refs = analyses.select("id", F.explode("document_ids").alias("document_id"))
    # Partial aggregation: an analysis goes when all of its references are among the deleted ones.
    dead = (
        refs.join(gone.select(F.col("id").alias("document_id"), F.lit(1).alias("gone")), "document_id", "left")
        .groupBy("id")
        .agg(F.count("gone").alias("lost"), F.count(F.lit(1)).alias("refs"))
        .filter("lost = refs")
        .select("id")
    )
    return analyses.join(dead, "id", "left_anti").select(*analyses.columns)


def cascade_delete(
    tables: dict[str, DataFrame], users: DataFrame | None = None, documents: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Delete accounts and/or documents with everything that hangs on them.

    ``users`` and ``documents`` hold the ids to delete in their first column. A deleted user takes
    along documents, analyses, conversations, messages and usage; a deleted document takes chunks,
    vectors and the analyses that refer to nothing else. Returns the tables that were given. A deleted
    user's rows are found through ``conversations`` (for messages) and ``documents`` or a ``user_id``
    (for chunks and vectors); if these are missing, the call fails rather than leave such rows behind.
    """
    out = dict(tables)
    if users is not None:
        if "messages" in tables and "conversations" not in tables:
            raise ValueError("messages of deleted users cannot be found without conversations")
        for name in ("chunks", "chunk_embeddings"):
            if name in tables and "documents" not in tables and "user_id" not in tables[name].columns:
                raise ValueError(f"{name} of deleted users cannot be found without documents")
    gone_docs = None
    if documents is not None:
        gone_docs = documents.select(F.col(documents.columns[0]).alias("id")).distinct()
    if users is not None:
        gone_users = users.select(F.col(users.columns[0]).alias("id")).distinct()
        owned = tables["documents"].join(
            gone_users.select(F.col("id").alias("user_id")), "user_id", "left_semi"
        ).select("id") if "documents" in tables else None
        if owned is not None:
            gone_docs = owned if gone_docs is None else gone_docs.unionByName(owned).distinct()
        if "conversations" in tables and "messages" in tables:
            talks = tables["conversations"].join(
                gone_users.select(F.col("id").alias("user_id")), "user_id", "left_semi"
            ).select("id")
            out["messages"] = _without(tables["messages"], talks, "conversation_id")
        if "users" in tables:
            out["users"] = _without(tables["users"], gone_users, "id")
        for name in ("documents", "analyses", "conversations", "usage", "chunks", "chunk_embeddings"):
            if name in tables and "user_id" in tables[name].columns:
                out[name] = _without(tables[name], gone_users, "user_id")
    if gone_docs is not None:
        if "documents" in out:
            out["documents"] = _without(out["documents"], gone_docs, "id")
        for name in ("chunks", "chunk_embeddings"):
            if name in out:
                out[name] = _without(out[name], gone_docs, "document_id")
        if "analyses" in out:
            out["analyses"] = _drop_fully_deleted(out["analyses"], gone_docs)
    return out


def find_orphans(
    documents: DataFrame, objects: DataFrame, chunks: DataFrame, vectors: DataFrame
) -> DataFrame:
    """Rows that lost their counterpart, as (issue, id).

    ``documents`` (id), ``objects`` (document_id), ``chunks`` (id, document_id), ``vectors`` (id).
    Each comparison is one aggregation over the tagged ids of both sides.
    """

    def unmatched(left: DataFrame, right: DataFrame, only_left: str, only_right: str | None) -> DataFrame:
        tagged = left.select("id", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
            right.select("id", F.lit(0).alias("l"), F.lit(1).alias("r"))
        )
        sides = tagged.groupBy("id").agg(F.max("l").alias("l"), F.max("r").alias("r"))
        issue = F.when((F.col("l") == 1) & (F.col("r") == 0), F.lit(only_left))
        if only_right is not None:
            issue = issue.when((F.col("l") == 0) & (F.col("r") == 1), F.lit(only_right))
        return sides.select(issue.alias("issue"), "id").filter("issue is not null")

    docs = documents.select("id")
    objs = objects.select(F.col("document_id").alias("id"))
    lost_parent = chunks.select(F.col("id").alias("chunk_id"), F.col("document_id").alias("id")).join(
        docs, "id", "left_anti"
    )
    return (
        unmatched(docs, objs, "document_without_object", "object_without_document")
        .unionByName(lost_parent.select(F.lit("chunk_without_document").alias("issue"), F.col("chunk_id").alias("id")))
        .unionByName(unmatched(vectors.select("id"), chunks.select("id"), "vector_without_chunk", None))
    )
