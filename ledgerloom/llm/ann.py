"""Approximate nearest neighbours by multiprobe p-stable hashing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import written
from ledgerloom.operators.grouped import sorted_groups

# Vectors and questions of a bucket that meet in one task.
BLOCK, ASKED = 4096, 1024
SIZES = (28, 24, 20, 16, 12, 10, 8, 6, 5, 4, 3, 2, 1)
# Questions whose exact answers, from the whole table, the index is fitted to.
FITTED_TO = 64
MEMBER, QUESTION = 0, 1


@dataclass
class Index:
    """Hash functions of all tables: ``floor((vector @ directions + offsets) / width)``.

    Vectors get one more component, which makes all of them equally long (``longest``), so that the
    nearest vector is the one with the largest inner product; a question's extra component is 0.
    """

    directions: np.ndarray  # (tables, functions, components + 1)
    offsets: np.ndarray  # (tables, functions)
    width: float
    longest: float
    probes: int
    recall: float = 0.0

    def project(self, vectors: np.ndarray, question: bool) -> np.ndarray:
        """Places of vectors on every line, in widths: (vectors, tables, functions)."""
        vectors = vectors.astype(np.float64)
        norms = np.linalg.norm(vectors, axis=1)
        if question:
            extra = np.zeros(len(vectors))
            scaled = vectors * (self.longest / norms)[:, None]
        else:
            extra = np.sqrt(np.maximum(self.longest**2 - norms**2, 0))
            scaled = vectors
        full = np.concatenate([scaled, extra[:, None]], axis=1)
        tables, functions, size = self.directions.shape
        lines = full @ self.directions.reshape(-1, size).T
        return (lines.reshape(len(full), tables, functions) + self.offsets) / self.width

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        return bucket_keys(np.floor(self.project(vectors, False)).astype(np.int64))

    def probe_keys(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Per question the keys of its own bucket and of perturbed ones in every table, likeliest first."""
        places = self.project(vectors, True)
        own = np.floor(places).astype(np.int64)
        out = []
        for one, inside in zip(own, places - own, strict=True):
            found = [perturbed(cell, part, self.probes) for cell, part in zip(one, inside, strict=True)]
            keys = [bucket_keys(cells[:, None, :], table=t)[:, 0] for t, cells in enumerate(found)]
            out.append(np.unique(np.concatenate(keys)))
        return out


def bucket_keys(cells: np.ndarray, table: int | None = None) -> np.ndarray:
    """64-bit keys of cells (vectors, tables, functions), which also tell tables apart."""
    tables = np.arange(cells.shape[1], dtype=np.uint64) if table is None else np.array([table], dtype=np.uint64)
    key = np.broadcast_to(tables + np.uint64(1), cells.shape[:2]).copy()
    for i in range(cells.shape[2]):
        key = (key ^ cells[:, :, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def perturbed(cell: np.ndarray, inside: np.ndarray, probes: int) -> np.ndarray:
    """``cell`` and up to ``probes`` neighbours of it, in the order of their estimated success.

    Leaving the cell over the border of function i costs the squared distance to it. Sets of such
    steps are made from cheap to dear with a heap, by shifting the dearest step of a set to the next
    one and by adding the next one; sets that cross both borders of a function are passed over.
    """
    distance = np.concatenate([inside, 1 - inside]) ** 2
    order = np.argsort(distance, kind="stable")
    cost, size = distance[order], len(cell)
    steps = [(int(o) % size, -1 if o < size else 1) for o in order]
    out = [cell]
    heap = [(float(cost[0]), (0,))] if probes else []
    while heap and len(out) <= probes:
        total, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < len(cost):
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
        if len({steps[c][0] for c in chosen}) == len(chosen):
            moved = cell.copy()
            for c in chosen:
                function, by = steps[c]
                moved[function] += by
            out.append(moved)
    return np.array(out)


def fit_index(
    sample: np.ndarray,
    asked: np.ndarray,
    answers: list[np.ndarray],
    longest: float,
    tables: int,
    probes: int,
    target: float,
    seed: int,
) -> Index:
    """The most selective index that finds ``target`` of the questions' exact ``answers``.

    The answers come from the whole table, so the recall is that of the table and not of a sample; how
    many rows a question visits is estimated from the share of ``sample`` in its buckets. The recall
    found is kept with the index. If no number of functions reaches the target, a single very wide cell
    holds everything.
    """
    random = np.random.default_rng(seed)
    size = sample.shape[1] + 1
    unit = max(longest, 1e-30)
    wanted = sum(map(len, answers))
    chosen, least = None, np.inf
    for functions in SIZES:
        for factor in (0.5, 1.0, 2.0):
            index = Index(
                random.standard_normal((tables, functions, size)),
                random.uniform(0, factor * unit, (tables, functions)),
                factor * unit,
                longest,
                probes,
            )
            if not wanted:
                return index
            keys, hit, visited = index.keys(sample), 0, 0
            for found, near in zip(index.probe_keys(asked), answers, strict=True):
                hit += np.isin(index.keys(near), found).any(axis=1).sum() if len(near) else 0
                visited += np.isin(keys, found).any(axis=1).sum()
            if hit >= target * wanted and visited < least:
                index.recall = hit / wanted
                chosen, least = index, visited
    if chosen is not None:
        return chosen
    return Index(random.standard_normal((1, 1, size)), np.full((1, 1), 1e6 * unit), 1e9 * unit, longest, 0, 1.0)


def as_vectors(column: pa.Array, kind: str) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype=kind).reshape(len(column), -1)


def best_products(asked: np.ndarray, vectors: np.ndarray, keep: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per question the ``keep`` best vectors; inner products are summed in one fixed order per pair."""
    rough = asked.astype(np.float64) @ vectors.astype(np.float64).T
    for i, row in enumerate(rough):
        if len(row) > keep:
            edge = np.partition(row, len(row) - keep)[len(row) - keep]
            near = np.flatnonzero(row >= edge - 1e-9 * (1 + abs(edge)))
        else:
            near = np.arange(len(row))
        exact = (vectors[near].astype(np.float64) * asked[i].astype(np.float64)).sum(axis=1)
        order = np.lexsort((near, -exact))[:keep]
        yield i, near[order], exact[order]


def meet(keep: int, kind: str):
    """Function for :func:`sorted_groups`: members and questions of a block, members first."""

    def fn(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        questions, members, scores = [], [], []
        kinds = rows.column("kind").to_numpy()
        ids = rows.column("node").to_numpy()
        vectors = rows.column("vector")
        for start, stop in zip(starts, [*starts[1:], rows.num_rows], strict=True):
            middle = start + int(np.searchsorted(kinds[start:stop], QUESTION))
            if middle in (start, stop):
                continue
            asked = as_vectors(vectors.slice(middle, stop - middle), kind)
            own = as_vectors(vectors.slice(start, middle - start), kind)
            for i, near, score in best_products(asked, own, keep):
                questions.append(np.full(len(near), ids[middle + i]))
                members.append(ids[start + near])
                scores.append(score)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, dtype=kind)
        return pa.table(
            {
                "question": pa.array(join(questions, np.int64)),
                "node": pa.array(join(members, np.int64)),
                "score": pa.array(join(scores, np.float64)),
            }
        )

    return fn


FOUND = T.StructType(
    [T.StructField("question", T.LongType()), T.StructField("node", T.LongType()), T.StructField("score", T.DoubleType())]
)


def in_blocks(members: DataFrame, questions: DataFrame, keep: int, kind: str) -> DataFrame:
    """Best pairs of members and questions (key, node, vector) with the same key.

    A key with many rows is cut into blocks: its members by their node, its questions by theirs, and
    each block of members meets each block of questions.
    """
    sizes = (
        members.groupBy("key")
        .agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("rows"))
        .join(questions.groupBy("key").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("cols")), "key")
    )
    sizes = written(sizes, "buckets")
    row = F.pmod(F.xxhash64("node"), F.col("rows")).cast("int")
    col = F.pmod(F.xxhash64("node"), F.col("cols")).cast("int")
    own = members.join(sizes, "key").select(
        "key", row.alias("row"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"),
        F.lit(MEMBER).alias("kind"), "node", "vector",
    )
    asked = questions.join(sizes, "key").select(
        "key", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), col.alias("col"),
        F.lit(QUESTION).alias("kind"), "node", "vector",
    )
    return sorted_groups(own.union(asked), ["key", "row", "col"], ["kind", "node"], meet(keep, kind), FOUND)


def keyed(vectors: DataFrame, index: Index, question: bool, kind: str) -> DataFrame:
    """(key, node, vector) for every bucket of every table that a vector is in, or that a question visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                data = as_vectors(part.column(1), kind)
                keys = index.probe_keys(data) if question else index.keys(data)
                which = pa.array(np.repeat(np.arange(len(data)), [len(k) for k in keys]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), part.column(0).take(which), part.column(1).take(which)],
                    names=["key", "node", "vector"],
                )

    return vectors.select("node", "vector").mapInArrow(run, "key bigint, node bigint, vector binary")


def usable(df: DataFrame, id_col: str, vector_col: str, kind: str) -> DataFrame:
    """(id, vector bytes, components, norm) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw, size, norm = [], [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = v.values
                if i is None or values is None or values.null_count or not len(values):
                    continue
                one = values.to_numpy(zero_copy_only=False).astype(kind)
                if np.isfinite(one).all() and one.any():
                    ids.append(i)
                    raw.append(one.tobytes())
                    size.append(len(one))
                    norm.append(float(np.linalg.norm(one.astype(np.float64))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(raw, pa.binary()), pa.array(size, pa.int32()), pa.array(norm, pa.float64())],
                names=["id", "vector", "size", "norm"],
            )

    source = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>" if kind == "f4" else "array<double>").alias("v"))
    return source.mapInArrow(run, "id bigint, vector binary, size int, norm double")


def nearest(
    vectors: DataFrame,
    asks: F.Column,
    k: int = 20,
    tables: int = 6,
    probes: int = 24,
    sample_rows: int = 4096,
    target: float = 0.97,
    seed: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest vectors by inner product of every row for which ``asks`` (on ``id``) holds.

    Returns query_id, rank (from 1), vec_id and score (double precision, original components),
    nearest first, ties to the smaller id; the row itself is no candidate of its own.

    Hash functions are fitted on at most ``sample_rows`` vectors (documented bound) and to the exact answers
    of 64 questions from the whole table, so they get more selective as it grows; every vector is put
    into a bucket of each table. A question visits its own bucket and ``probes`` perturbed ones
    per table, in the order of their estimated success; all candidates get their exact score. Buckets
    are compared in blocks, whatever their size. Equal vectors are one node with the ``k + 1`` smallest
    of their ids, which is all that a result can need, so groups of copies cost nothing. Questions
    that found fewer than ``k`` others are answered exactly, against all vectors in blocks.

    Vectors that are null, zero, empty or hold null or non-finite components take no part, nor do
    rows without an id or with another number of components than most. Of rows that share an id and a
    vector one counts.
    """
    # Floats stay as they are; components of any other type count as doubles.
    kind = "f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "f8"
    rows = written(usable(vectors, id_col, vector_col, kind), "vectors")
    spark = rows.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    size = rows.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if size is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.col("size") == size["size"]).dropDuplicates(["id", "vector"])
    # Nodes: distinct vectors with their smallest ids. Ids are ranked per salted part before they meet.
    ranked = Window.partitionBy("vector", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    few = rows.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k + 1)
    nodes = written(
        few.groupBy("vector").agg(
            F.min("id").alias("node"), F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"), F.max("norm").alias("norm")
        ),
        "nodes",
    )
    asked = rows.where(asks).select("id", "vector")
    asked = written(asked.join(nodes.select("vector", "node"), "vector").select("id", "node"), "questions")
    questions = written(asked.select("node").distinct().join(nodes, "node").select("node", "vector"), "question-nodes")
    longest = nodes.agg(F.max("norm")).first()[0]
    order = F.xxhash64("node"), "node"
    sample = nodes.orderBy(*order).limit(sample_rows).select("vector").toArrow().column(0).combine_chunks()
    # One bucket for all; a constant would turn the joins by bucket into nested loops.
    everything = F.pmod(F.xxhash64("node"), F.lit(1)).cast("bigint").alias("key")
    some = written(questions.orderBy(*order).limit(FITTED_TO).select(everything, "node", "vector"), "fitted-to")
    near = best(in_blocks(nodes.select(everything, "node", "vector"), some, k + 1, kind), k + 1).where("question <> node")
    # At most 64 questions with k + 1 answers each.
    near = near.join(nodes.select("node", "vector"), "node").select("question", "vector").collect()
    tried = some.select("node", "vector").collect()
    if not tried:
        return spark.createDataFrame([], schema)
    answers = [np.array([np.frombuffer(r["vector"], kind) for r in near if r["question"] == q["node"]]) for q in tried]
    fitted = fit_index(
        as_vectors(sample, kind),
        np.array([np.frombuffer(r["vector"], kind) for r in tried]),
        answers, longest, tables, probes, target, seed,
    )
    met = in_blocks(keyed(nodes, fitted, False, kind), keyed(questions, fitted, True, kind), k + 1, kind)
    found = written(best(met.distinct(), k + 1), "found")
    # Exact answers for those that found too few.
    held = nodes.select(F.col("node"), F.size("ids").alias("n"))
    enough = found.join(held, "node").groupBy("question").agg(F.sum("n").alias("n")).where(F.col("n") > k)
    short = written(questions.join(enough.select(F.col("question").alias("node")), "node", "left_anti"), "short")
    total = nodes.agg(F.sum(F.size("ids"))).first()[0]
    if total > 1 and short.limit(1).count():
        every = in_blocks(nodes.select(everything, "node", "vector"), short.select(everything, "node", "vector"), k + 1, kind)
        found = best(found.join(short.select(F.col("node").alias("question")), "question", "left_anti").union(every), k + 1)
    # From nodes to ids: k + 1 per question node are enough, as a question leaves out itself only.
    ids = found.join(nodes.select("node", "ids"), "node").select("question", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("question").orderBy(F.desc("score"), "vec_id")
    ids = ids.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    near = ids.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("id")), 1, k)
    out = asked.join(near, asked["node"] == near["question"]).select(
        F.col("id").alias("query_id"), F.posexplode(others).alias("at", "hit")
    )
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


def best(met: DataFrame, keep: int) -> DataFrame:
    """The best nodes of each question: by score, then by the smaller node."""
    order = Window.partitionBy("question").orderBy(F.desc("score"), "node")
    return met.withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep).drop("r")
