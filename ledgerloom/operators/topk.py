"""Exact top-k similarity join: the k best vectors of its group for every question.

Pairs of questions and vectors are never rows. A task scores a block of vectors against a block of
questions with one matrix product and keeps k candidates per question; only those are shuffled.

Two ways to bring the blocks together:

* few questions (at most ``BROADCAST_ROWS`` and ``MAX_SENT_NUMBERS``, measured first): they are sent
  to all tasks and the vector table is scanned once, with no shuffle of vectors at all;
* many questions: both sides are shuffled on (group, vector block, question block). The number of
  blocks of a group follows from its row count, so a group that holds a third of all rows becomes
  many blocks of the same size as everybody else's. The row counts read the group columns only. A side's rows
  travel once per block of the other side, so blocks that were asked for smaller than ``VECTOR_BLOCK`` and
  ``FULL_QUESTIONS`` grow up to these before a group gets more than ``MOST_BLOCKS`` of them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import BROADCAST_ROWS, rows_if_bounded

SCORE_DIGITS = 6
VECTOR_BLOCK = 20_000
QUESTION_BLOCK = 2_000
FULL_QUESTIONS = 16_000
MOST_BLOCKS = 16
_TILE_ROWS = 2_048
_TILE_QUESTIONS = 128
MAX_SENT_NUMBERS = 2**22  # vector elements sent to every task: 32 MB as doubles
_NO_SCORE = -2.0  # below every cosine: a zero vector ranks last


class _Questions:
    """The questions of one group as a matrix, with their scopes."""

    def __init__(self, rows: pa.Table):
        vectors = _column(rows, "embedding")
        self.qids = rows.column("qid").to_pylist()
        self.unit, self.zero = _unit_rows(_matrix(vectors, len(vectors[0])))
        self.scopes = [None if s is None else set(s) for s in rows.column("document_ids").to_pylist()]
        self.scoped = [i for i, s in enumerate(self.scopes) if s is not None]

    def take(self, at: np.ndarray) -> _Questions:
        """The questions at some places."""
        some = object.__new__(_Questions)
        some.qids, some.scopes = [self.qids[i] for i in at], [self.scopes[i] for i in at]
        some.unit, some.zero = self.unit[at], self.zero[at]
        some.scoped = [i for i, s in enumerate(some.scopes) if s is not None]
        return some


def _unit_rows(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt((m * m).sum(axis=1))
    zero = norms == 0
    return m / np.where(zero, 1.0, norms)[:, None], zero


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles; another size than the questions' is an error."""
    flat = column.flatten()
    if flat.null_count or not pc.all(pc.equal(pc.list_value_length(column), width)).as_py():
        raise ValueError(f"vectors must have {width} elements and no nulls")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _candidates(
    q: _Questions, ids: np.ndarray, docs: np.ndarray | None, vectors: np.ndarray, k: int, digits: int
) -> Iterator[pd.DataFrame]:
    """The k best vectors per question of every tile, ties to the smaller id."""
    unit, zero = _unit_rows(vectors)
    for r in range(0, len(ids), _TILE_ROWS):
        rows = slice(r, r + _TILE_ROWS)
        codes, names = pd.factorize(docs[rows]) if docs is not None and q.scoped else (None, ())
        for b in range(0, len(q.qids), _TILE_QUESTIONS):
            block = slice(b, b + _TILE_QUESTIONS)
            scores = np.round(q.unit[block] @ unit[rows].T, digits) + 0.0
            scores[:, zero[rows]] = _NO_SCORE
            scores[q.zero[block]] = _NO_SCORE
            for i in q.scoped[bisect_left(q.scoped, b) : bisect_left(q.scoped, b + _TILE_QUESTIONS)]:
                inside = np.fromiter((n in q.scopes[i] for n in names), bool, len(names))
                scores[i - b, ~inside[codes]] = -np.inf
            n = scores.shape[1]
            floor = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
            kept = (scores >= floor[:, None]) & (scores > -np.inf)
            if np.count_nonzero(kept) > k * len(scores):
                _cut_ties(kept, scores == floor[:, None], k, np.argsort(ids[rows], kind="stable"))
            qi, vi = np.nonzero(kept)
            if len(qi):
                yield pd.DataFrame({"q": qi + b, "id": ids[rows][vi], "score": scores[qi, vi]})


def _cut_ties(kept: np.ndarray, tied: np.ndarray, k: int, by_id: np.ndarray) -> None:
    """Keep as many of each question's vectors tied at the k-th place as there is room for, by id."""
    tied &= kept
    room = k - (kept & ~tied).sum(axis=1)
    first = tied[:, by_id]
    first &= np.cumsum(first, axis=1, dtype=np.int32) <= room[:, None]
    kept &= ~tied
    kept[:, by_id] |= first


def _keep_best(found: list[pd.DataFrame], k: int) -> pd.DataFrame:
    both = pd.concat(found, ignore_index=True)
    ranked = both.sort_values(["q", "score", "id"], ascending=[True, False, True], kind="stable")
    return ranked.groupby("q", sort=False).head(k)


def _column(table: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    c = table.column(name)
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def _arrow(best: pd.DataFrame, qids: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([qids[i] for i in best["q"]], type=schema.field(0).type),
            pa.array(best["id"].tolist(), type=schema.field(1).type),
            pa.array(best["score"].to_numpy(), type=pa.float64()),
        ],
        schema=schema,
    )


def _arrow_type(kind: T.DataType) -> pa.DataType:
    simple = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32()}
    if kind not in simple:
        raise TypeError(f"ids must be strings or integers, not {kind.simpleString()}")
    return simple[kind]


def _out_schemas(questions: DataFrame, chunks: DataFrame) -> tuple[T.StructType, pa.Schema]:
    q, c = questions.schema["qid"].dataType, chunks.schema["id"].dataType
    spark_schema = T.StructType(
        [T.StructField("qid", q), T.StructField("id", c), T.StructField("score", T.DoubleType())]
    )
    return spark_schema, pa.schema([("qid", _arrow_type(q)), ("id", _arrow_type(c)), ("score", pa.float64())])


def _fetch_if_few(questions: DataFrame, max_rows: int) -> pa.Table | None:
    """The questions if they are few enough to send to every task, by number and by size."""
    rows = questions.limit(max_rows + 1).toArrow()
    few = rows.num_rows <= max_rows and len(_column(rows, "embedding").flatten()) <= MAX_SENT_NUMBERS
    return rows if few else None


def _scan_with_sent_questions(
    rows: pa.Table, questions: DataFrame, chunks: DataFrame, on: Sequence[str], k: int, digits: int
) -> DataFrame:
    spark = chunks.sparkSession
    schema, arrow_schema = _out_schemas(questions, chunks)
    by_group: dict[tuple, list[int]] = {}
    for i, group in enumerate(zip(*(rows.column(c).to_pylist() for c in on)) if on else [()] * rows.num_rows):
        by_group.setdefault(group, []).append(i)
    qids: list = []
    packed: dict[tuple, tuple[int, pa.Table]] = {}
    for group, members in by_group.items():
        # Plain tables are sent, as a broadcast of own classes would need the package on every executor.
        packed[group] = (len(qids), rows.take(pa.array(members)))
        qids.extend(_Questions(packed[group][1]).qids)
    sent = spark.sparkContext.broadcast((packed, qids))
    for c in on:  # prunes partitions and row groups when the groups asked about are few
        values = {g[on.index(c)] for g in by_group}
        if len(values) <= 200:
            chunks = chunks.filter(F.col(c).isin(sorted(values)))
    on_cols = list(on)
    most_held = max(200_000, 4 * k * len(qids))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, names = sent.value
        groups = {group: (first, _Questions(table)) for group, (first, table) in tables.items()}
        found: list[pd.DataFrame] = []
        held = 0
        for batch in batches:
            keys = pd.DataFrame({c: batch.column(c).to_pandas() for c in on_cols}) if on_cols else None
            members = keys.groupby(on_cols, sort=False).indices if on_cols else {(): np.arange(batch.num_rows)}
            for key, at in members.items():
                group = groups.get(key if isinstance(key, tuple) else (key,))
                if group is None:
                    continue
                first, q = group
                part = batch.take(pa.array(at))
                ids = part.column("id").to_pandas().to_numpy()
                docs = part.column("document_id").to_pandas().to_numpy() if q.scoped else None
                vectors = _matrix(part.column("embedding"), q.unit.shape[1])
                for piece in _candidates(q, ids, docs, vectors, k, digits):
                    piece["q"] += first
                    found.append(piece)
                    held += len(piece)
            if held > most_held:
                found = [_keep_best(found, k)]
                held = len(found[0])
        if found:
            yield _arrow(_keep_best(found, k), names, arrow_schema)

    columns = ["id", *on, *([] if "document_id" in on else ["document_id"]), "embedding"]
    return chunks.select(*columns).mapInArrow(scan, schema)


def _block_join(
    questions: DataFrame, chunks: DataFrame, on: Sequence[str], k: int, digits: int, v_block: int, q_block: int, lists: bool = False
) -> DataFrame:
    """The k best of every pair of blocks. With ``lists``, vectors carry ``list_id`` and questions ``lists``, those they search."""
    schema, arrow_schema = _out_schemas(questions, chunks)
    on = list(on)
    # Both may come from one table; columns of their own keep them apart.
    questions = questions.select(*[F.col(c).alias(c) for c in questions.columns])

    def small_if_few(df: DataFrame) -> DataFrame:
        """Broadcast a list of groups that turns out short; a long one is joined like any table."""
        rows = rows_if_bounded(df)
        return df if rows is None else F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))

    def big_groups(df: DataFrame, size: int, full: int, name: str) -> DataFrame:
        """Groups that need more than one block; at most (rows / size) of them exist."""
        rows = F.count(F.lit(1))
        blocks = F.least(F.ceil(rows / size), F.greatest(F.lit(MOST_BLOCKS), F.ceil(rows / max(size, full)))).cast("int").alias(name)
        return small_if_few(df.groupBy(*on).agg(blocks).filter(F.col(name) > 1))

    v_blocks, q_blocks = big_groups(chunks, v_block, VECTOR_BLOCK, "_nv"), big_groups(questions, q_block, FULL_QUESTIONS, "_nq")

    def placed(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        sized = df.join(v_blocks, on, "left").join(q_blocks, on, "left").fillna(1, ["_nv", "_nq"])
        mine, theirs = F.col(f"_n{own}"), F.col(f"_n{other}")
        return (
            sized.withColumn(f"_{own}", F.pmod(F.xxhash64(key), mine).cast("int"))
            .withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), theirs - 1)))
            .drop("_nv", "_nq")
        )

    asked = small_if_few(questions.select(*on).distinct())
    q_side = placed(questions.select("qid", *on, "embedding", "document_ids", *(["lists"] if lists else [])), "qid", "q", "v")
    columns = ["id", *on, *([] if "document_id" in on else ["document_id"]), *(["list_id"] if lists else []), "embedding"]
    v_side = placed(chunks.select(*columns).join(asked, on, "left_semi"), "id", "v", "q")
    keys = [*on, "_v", "_q"]

    def score(q_rows: pa.Table, v_rows: pa.Table) -> pa.Table:
        if q_rows.num_rows == 0 or v_rows.num_rows == 0:
            return arrow_schema.empty_table()
        q = _Questions(q_rows)
        ids = v_rows.column("id").to_pandas().to_numpy()
        docs = v_rows.column("document_id").to_pandas().to_numpy() if q.scoped else None
        vectors = _matrix(_column(v_rows, "embedding"), q.unit.shape[1])
        found: list[pd.DataFrame] = []
        for some, at in _searched(q_rows, v_rows) if lists else [(None, slice(None))]:
            part = q if some is None else q.take(some)
            for piece in _candidates(part, ids[at], None if docs is None else docs[at], vectors[at], k, digits):
                if some is not None:
                    piece["q"] = some[piece["q"]]
                found.append(piece)
            if sum(map(len, found)) > 4 * k * len(q.qids):
                found = [_keep_best(found, k)]
        if not found:
            return arrow_schema.empty_table()
        return pa.Table.from_batches([_arrow(_keep_best(found, k), q.qids, arrow_schema)])

    return q_side.groupBy(*keys).cogroup(v_side.groupBy(*keys)).applyInArrow(score, schema)


def _searched(q_rows: pa.Table, v_rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per list of the vectors that is searched: which questions search it, and its vectors."""
    asked = _column(q_rows, "lists")
    who = np.repeat(np.arange(len(asked)), pc.list_value_length(asked).to_numpy(zero_copy_only=False))
    which = asked.flatten().to_numpy(zero_copy_only=False)
    by_list = np.argsort(which, kind="stable")
    held = v_rows.column("list_id").to_numpy()
    order = np.argsort(held, kind="stable")
    numbers, first = np.unique(held[order], return_index=True)
    for n, at in zip(numbers, np.split(order, first[1:])):
        some = who[by_list[np.searchsorted(which[by_list], n, "left") : np.searchsorted(which[by_list], n, "right")]]
        if len(some):
            yield some, at


def listed_topk(questions: DataFrame, chunks: DataFrame, k: int, n_lists: int, digits: int = SCORE_DIGITS) -> DataFrame:
    """:func:`topk_join` by ``user_id`` for many questions that search some lists each: (qid, id, score, rank).

    ``questions`` has ``lists``, an array of those it searches, ``chunks`` has ``list_id``. Neighbouring lists
    are put together to about a block of vectors, and a question travels to each such range once instead of to each list.
    """
    chunks = chunks.dropna(subset=["embedding", "user_id"])
    ranges = min(n_lists, max(1, -(-chunks.count() // VECTOR_BLOCK)))
    of = lambda c: F.floor(c * ranges / n_lists).cast("int")
    asked = questions.dropna(subset=["embedding", "user_id"]).withColumn("_range", F.explode(F.array_distinct(F.transform("lists", of))))
    asked = asked.withColumn("lists", F.filter("lists", lambda n: of(n) == F.col("_range")))
    held = chunks.filter("list_id >= 0").withColumn("_range", of(F.col("list_id")))
    return _best(_block_join(asked, held, ["user_id", "_range"], k, digits, VECTOR_BLOCK, QUESTION_BLOCK, lists=True), k)


def topk_join(questions: DataFrame, chunks: DataFrame, on: Sequence[str], k: int, **options: int) -> DataFrame:
    """The rows of :func:`topk_join_sized`."""
    return topk_join_sized(questions, chunks, on, k, **options)[0]


def topk_join_sized(
    questions: DataFrame,
    chunks: DataFrame,
    on: Sequence[str],
    k: int,
    digits: int = SCORE_DIGITS,
    max_sent: int = BROADCAST_ROWS,
    v_block: int = VECTOR_BLOCK,
    q_block: int = QUESTION_BLOCK,
) -> tuple[DataFrame, bool]:
    """(qid, id, score, rank) of each question's k best vectors among those that agree on ``on``.

    ``questions`` is (qid, *on, embedding, document_ids); a null ``document_ids`` is unscoped and an
    empty one matches nothing. ``chunks`` is (id, document_id, *on, embedding). Scores are cosine
    similarities rounded to ``digits``, so that equal vectors tie whatever the order of summation;
    ties go to the smaller id; a zero vector has no score and ranks last. A question may appear
    once per group. Counts the questions first (one bounded job); the second value returned tells
    whether they are few, and the result therefore at most ``max_sent * k`` rows.
    """
    questions = questions.select("qid", *on, "embedding", "document_ids").dropna(subset=["embedding", *on])
    chunks = chunks.dropna(subset=["embedding", *on])
    rows = _fetch_if_few(questions, max_sent) if max_sent > 0 else None
    if rows is not None:
        partial = _scan_with_sent_questions(rows, questions, chunks, on, k, digits)
    else:
        partial = _block_join(questions, chunks, on, k, digits, v_block, q_block)
    return _best(partial, k), rows is not None


def _best(partial: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    ranked = partial.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.withColumn("score", F.when(F.col("score") > _NO_SCORE, F.col("score")))
