"""Similarity search over chunk vectors."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import dot, l2_norm
from ledgerloom.operators.access import apply_filters, scope_to_user
from ledgerloom.operators.topk import SCORE_DIGITS, listed_topk, topk_join, topk_join_sized
from ledgerloom.session import BROADCAST_ROWS

# How many chunks a question gets, and how many after widening.
DEFAULT_K = 8
WIDE_K = 16
MAX_DIMENSIONS = 64
MAX_LISTS = 4096


def _score(column: str, vector: Sequence[float], digits: int) -> F.Column:
    """Cosine with a fixed vector, rounded; null when either length is zero. Another size is an error."""
    fixed = np.asarray(vector, dtype=np.float64)
    length = float(np.sqrt((fixed * fixed).sum()))
    unit = F.lit([float(x) for x in (fixed / length if length else fixed)])
    cosine = F.try_divide(dot(column, unit), l2_norm(column)) if length else F.lit(None).cast("double")
    same = F.col(column).isNull() | (F.size(column) == len(fixed))
    wrong = F.raise_error(F.lit(f"vectors must have {len(fixed)} elements")).cast("double")
    return F.when(same, F.round(cosine, digits) + 0.0).otherwise(wrong)


def _without_vector(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("embedding", "user_id", "chunk_index")]


def vector_search(
    chunks: DataFrame,
    vector: Sequence[float],
    k: int,
    user_id: object,
    document_ids: Sequence[object] | None = None,
    digits: int = SCORE_DIGITS,
    **filters: object,
) -> DataFrame:
    """The k chunks of one user most similar to ``vector``, best first, ties by id.

    Owner and document filters come before the ranking and reach the Parquet scan; the result holds
    the hit columns and ``score``. Every task keeps k rows.
    """
    scoped = apply_filters(scope_to_user(chunks, user_id), {"document_ids": document_ids, **filters})
    hits = scoped.select(*_without_vector(chunks), _score("embedding", vector, digits).alias("score"))
    return hits.orderBy(F.col("score").desc_nulls_last(), "id").limit(k)


def batch_vector_search(
    questions: DataFrame, chunks: DataFrame, k: int = DEFAULT_K, payload: bool = True, **options: int
) -> DataFrame:
    """:func:`vector_search` for many questions: (qid, rank, score, *hit columns).

    ``questions`` is (qid, user_id, embedding, document_ids). The ranking reads only ids and vectors;
    with ``payload`` the other chunk columns are then fetched for the hits alone.
    """
    hits, few = topk_join_sized(questions, chunks, ["user_id"], k, **options)
    return _with_payload(hits, chunks, few) if payload else hits


def _with_payload(hits: DataFrame, chunks: DataFrame, few: bool) -> DataFrame:
    """Chunk columns for the hits; few hits travel to the chunks, so the texts are not shuffled."""
    hits = F.broadcast(hits) if few else hits
    return hits.join(chunks.select(*_without_vector(chunks)), "id").select(
        "qid", "rank", "score", *_without_vector(chunks)
    )


def retrieve_with_policy(
    questions: DataFrame,
    chunks: DataFrame,
    min_score: float,
    floor: float,
    k: int = DEFAULT_K,
    k_wide: int = WIDE_K,
    **options: int,
) -> DataFrame:
    """Hits per question with a verdict: ``ok`` (k hits), ``weak`` (k_wide hits) or ``not_found`` (none).

    The best score decides: at least ``min_score`` is ok, below ``floor`` or no hit is not found.
    Every question appears; one without hits has a single row with null hit columns.
    """
    wide = topk_join(questions, chunks, ["user_id"], max(k, k_wide), **options)
    best = F.max("score").over(Window.partitionBy("qid"))
    verdict = F.when(F.col("_best") >= min_score, "ok").when(F.col("_best") >= floor, "weak")
    kept = (
        wide.withColumn("_best", best)
        .withColumn("verdict", verdict)
        .filter(F.col("rank") <= F.when(F.col("verdict") == "ok", k).when(F.col("verdict") == "weak", k_wide))
        .drop("_best")
    )
    answers = questions.select("qid").join(kept, "qid", "left")
    return answers.withColumn("verdict", F.coalesce("verdict", F.lit("not_found")))


def retrieve_by_dimension(
    dimensions: Mapping[str, Sequence[float]],
    chunks: DataFrame,
    document_ids: Sequence[object] | DataFrame | None,
    n: int,
    digits: int = SCORE_DIGITS,
) -> DataFrame:
    """The n best chunks for every comparison dimension within every document.

    ``dimensions`` maps a name to its vector (at most 64, every task gets them). A block of vectors is multiplied with
    all of them at once and keeps n rows per dimension and document, so pairs of a dimension and a chunk
    are never rows; other columns are fetched for the hits alone, by id.
    """
    if not 0 < len(dimensions) <= MAX_DIMENSIONS:
        raise ValueError(f"need 1 to {MAX_DIMENSIONS} dimensions")
    names = list(dimensions)
    asked = [np.asarray(v, dtype=np.float64) for v in dimensions.values()]
    units = np.stack([v / (np.linalg.norm(v) or 1.0) for v in asked])
    scoped = apply_filters(chunks, {"document_ids": document_ids})
    id_type, document_type = scoped.schema["id"].dataType, scoped.schema["document_id"].dataType
    fields = [("id", id_type), ("document_id", document_type), ("dimension", T.StringType()), ("score", T.DoubleType())]

    def best_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The n best rows of the batch for every dimension and document."""
        column = batch.column("embedding")
        sizes = pc.list_value_length(column)
        if not pc.all(pc.fill_null(pc.equal(sizes, units.shape[1]), True)).as_py():
            raise ValueError(f"vectors must have {units.shape[1]} elements")
        given = column.is_valid().to_numpy(zero_copy_only=False)
        vectors = np.zeros((batch.num_rows, units.shape[1]))
        vectors[given] = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, units.shape[1])
        norms = np.linalg.norm(vectors, axis=1)
        known = norms > 0
        scores = np.round(units @ (vectors / np.where(known, norms, 1)[:, None]).T, digits) + 0.0
        scores[:, ~known] = -np.inf
        scores[~units.any(axis=1)] = -np.inf
        documents = pd.factorize(batch.column("document_id").to_pandas(), use_na_sentinel=False)[0]
        by_id = np.argsort(np.argsort(batch.column("id").to_pandas().to_numpy(), kind="stable"), kind="stable")
        rows, which = [], []
        for d, score in enumerate(scores):
            order = np.lexsort((by_id, -score, documents))
            first = np.flatnonzero(np.diff(documents[order], prepend=-1))
            place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            rows.append(order[place < n])
            which.append(np.full(len(rows[-1]), d))
        row, dimension = pa.array(np.concatenate(rows)), np.concatenate(which)
        found = scores[dimension, np.concatenate(rows)]
        columns = [batch.column("id").take(row), batch.column("document_id").take(row)]
        columns += [pa.array([names[d] for d in dimension], pa.string()), pa.array(found, mask=~np.isfinite(found))]
        return pa.RecordBatch.from_arrays(columns, names=[f for f, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (best_of(b) for b in batches if b.num_rows)

    schema = T.StructType([T.StructField(name, kind) for name, kind in fields])
    met = scoped.select("id", "document_id", "embedding").mapInArrow(run, schema)
    best = Window.partitionBy("dimension", "document_id").orderBy(F.col("score").desc_nulls_last(), "id")
    hits = met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n).drop("document_id")
    columns = _without_vector(chunks)
    return hits.join(scoped.select(*columns), "id").select(*columns, "dimension", "score", "rank")


@dataclass(frozen=True)
class IvfIndex:
    """Coarse clusters: ``vectors`` carries ``list_id``; ``centroids`` has one unit row per list."""

    vectors: DataFrame
    centroids: np.ndarray


def build_ivf(
    vectors: DataFrame, n_lists: int, seed: int = 42, max_iter: int = 20, out_dir: str | None = None
) -> IvfIndex:
    """Cluster the vectors by direction and label each with its cluster.

    With ``out_dir`` the labelled vectors are written partitioned by ``list_id``, so that a search
    reads only the lists it probes. Runs the clustering job. Zero vectors get list -1.
    """
    if not 2 <= n_lists <= MAX_LISTS:
        raise ValueError(f"need 2 to {MAX_LISTS} lists")
    zero = l2_norm("embedding") == 0
    # Directions only: a zero vector has none, gets a stand-in and is labelled apart afterwards.
    point = F.when(zero, F.transform("embedding", lambda _: F.lit(1.0))).otherwise(F.col("embedding").cast("array<double>"))
    points = vectors.filter("embedding is not null").withColumn("_point", array_to_vector(point))
    model = KMeans(
        k=n_lists, seed=seed, maxIter=max_iter, distanceMeasure="cosine", featuresCol="_point", predictionCol="list_id"
    ).fit(points.filter(~zero))
    labelled = model.transform(points).drop("_point")
    labelled = labelled.withColumn("list_id", F.when(zero, F.lit(-1)).otherwise(F.col("list_id")))
    if out_dir is not None:
        labelled.write.mode("errorifexists").partitionBy("list_id").parquet(out_dir)
        labelled = vectors.sparkSession.read.parquet(out_dir)
    centers = np.asarray(model.clusterCenters(), dtype=np.float64)
    norms = np.linalg.norm(centers, axis=1, keepdims=True)
    return IvfIndex(labelled, centers / np.where(norms == 0, 1.0, norms))


def ann_search(
    questions: DataFrame, index: IvfIndex, k: int = DEFAULT_K, n_probe: int = 8, **options: int
) -> DataFrame:
    """Approximate :func:`batch_vector_search`: only the ``n_probe`` nearest lists are searched, exactly.

    Few questions (with their lists, as in :func:`topk_join`) are sent to all tasks, many meet ranges of lists.
    """
    centroids = index.centroids
    take = min(n_probe, len(centroids))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def nearest(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        near = np.argsort(-(np.stack(v.to_numpy()).astype(np.float64) @ centroids.T), axis=1, kind="stable")[:, :take]
        return pd.Series(list(near.astype(np.int32)))

    asked = questions.filter("embedding is not null").select(
        "qid", "user_id", "embedding", "document_ids", nearest("embedding").alias("lists")
    )
    if options or asked.limit(BROADCAST_ROWS // take + 1).count() <= BROADCAST_ROWS // take:
        probes = asked.withColumn("list_id", F.explode("lists")).drop("lists")
        return topk_join(probes, index.vectors, ["user_id", "list_id"], k, **options)
    return listed_topk(asked, index.vectors, k, len(centroids))


def recall_at_k(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search found, over all questions (one row)."""
    found = approximate.select("qid", "id", F.lit(1).alias("found"))
    joined = exact.select("qid", "id").join(found, ["qid", "id"], "left")
    return joined.agg(
        F.count(F.lit(1)).alias("exact_hits"),
        F.count("found").alias("found_hits"),
        F.try_divide(F.count("found"), F.count(F.lit(1))).alias("recall"),
    )
