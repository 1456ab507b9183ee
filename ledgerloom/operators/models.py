"""Embedding and text models applied to tables."""

from __future__ import annotations

import hashlib
import json
import math
import random
import threading
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import hash_embedding, token_count
from ledgerloom.operators.retry import BASE_DELAY_S, MAX_DELAY_S, MAX_JITTER, MAX_RETRIES, RETRYABLE_CODES

# Calls that a task has under way at a time.
CONCURRENT_CALLS = 8


class EmbeddingModel(Protocol):
    """What a pluggable embedding model offers; must be picklable."""

    provider: str
    model: str
    dimension: int

    def embed_documents(self, texts: Sequence[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


class ModelError(Exception):
    """A failed model call: ``outcome`` is stored with the row, ``code`` decides on retries."""

    def __init__(self, outcome: str, message: str = "", code: int | None = None, retry_after: float = 0.0):
        super().__init__(message)
        self.outcome, self.code, self.retry_after = outcome, code, retry_after


class HashModel:
    """The deterministic embedding as a plug-in model; gives what ``hash_embed`` gives."""

    provider = "fake"

    def __init__(self, dimension: int = 16, model: str = "fake-embedding"):
        self.dimension, self.model = dimension, model

    def embed_query(self, text: str) -> list[float]:
        raw = text.encode()
        blocks = (hashlib.sha256(raw + c.to_bytes(4, "big")).digest() for c in range((self.dimension + 7) // 8))
        stream = b"".join(blocks)
        ints = [int.from_bytes(stream[4 * i : 4 * i + 4], "big") for i in range(self.dimension)]
        vec = [n / 2.0**31 - 1 for n in ints]
        length = math.hypot(*vec) or 1.0
        return [x / length for x in vec]

    def embed_documents(self, texts: Sequence[str]) -> list[list[float]]:
        return [self.embed_query(t) for t in texts]


def hash_embed(df: DataFrame, text_col: str = "text", dim: int = 16, out: str = "embedding") -> DataFrame:
    """Add the deterministic embedding of ``text_col``; stays inside the JVM."""
    return df.withColumn(out, hash_embedding(text_col, dim))


def embed_batches(
    df: DataFrame,
    text_col: str,
    model: EmbeddingModel,
    task: str = "document",
    batch_size: int = 256,
    out: str = "embedding",
) -> DataFrame:
    """Add ``out`` from a pluggable model, called with up to ``batch_size`` texts at a time.

    The model object is unpickled once per task. A wrong number of vectors or a wrong vector size
    fails the job.
    """
    if task not in ("document", "query"):
        raise ValueError(f"unknown task {task!r}")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vectors: list[list[float]] = []
            for i in range(0, len(texts), batch_size):
                part = [t or "" for t in texts.iloc[i : i + batch_size]]
                got = model.embed_documents(part) if task == "document" else [model.embed_query(t) for t in part]
                if len(got) != len(part):
                    raise ValueError(f"model returned {len(got)} vectors for {len(part)} texts")
                if any(len(v) != model.dimension for v in got):
                    raise ValueError(f"model returned a vector whose size is not {model.dimension}")
                vectors.extend(list(map(float, v)) for v in got)
            yield pd.Series(vectors, index=texts.index, dtype=object)

    return df.withColumn(out, embed(F.col(text_col)))


def embedding_usage(df: DataFrame, text_col: str, model: EmbeddingModel, by: Sequence[str] = ()) -> DataFrame:
    """Usage rows for embedding ``df``: words in, none out."""
    return df.groupBy(*by).agg(
        F.lit("embedding").alias("kind"),
        F.lit(model.provider).alias("provider"),
        F.lit(model.model).alias("model"),
        F.sum(token_count(text_col)).alias("tokens_in"),
        F.lit(0).alias("tokens_out"),
    )


def check_embedding_space(index_meta: DataFrame, provider: str, model: str, dim: int) -> DataFrame:
    """The index's meta row: recorded when there is none, and an error when it differs.

    Reads one row, the one with the highest id.
    """
    newest = index_meta.orderBy(F.col("id").desc()).limit(1).collect()
    if not newest:
        row = [(1, provider, model, dim)]
        fresh = index_meta.sparkSession.createDataFrame(
            row, "id bigint, embedding_provider string, embedding_model string, dimension int"
        )
        return fresh.withColumn("updated_at", F.current_timestamp()).select(*index_meta.columns)
    stored = (newest[0]["embedding_provider"], newest[0]["embedding_model"], newest[0]["dimension"])
    if stored != (provider, model, dim):
        raise ValueError(
            f"embedding configuration changed: configured {(provider, model, dim)!r}, index holds {stored!r}; re-index first"
        )
    return index_meta.filter(F.col("id") == newest[0]["id"])


def space_verdicts(
    indexes: DataFrame, index_meta: DataFrame, keys: Sequence[str], provider: str, model: str, dim: int
) -> DataFrame:
    """:func:`check_embedding_space` for many indexes at once: ``recorded``, ``kept`` or ``refused`` per index.

    ``index_meta`` has the indexes' ``keys`` and a meta row or more each, of which that with the highest id counts.
    """
    columns = ["embedding_provider", "embedding_model", "dimension"]
    newest = index_meta.groupBy(*keys).agg(F.max_by(F.struct(*columns), "id").alias("_meta"))
    same = (
        (F.col("_meta.embedding_provider") == provider) & (F.col("_meta.embedding_model") == model) & (F.col("_meta.dimension") == dim)
    )
    verdict = F.when(F.col("_meta").isNull(), "recorded").when(F.coalesce(same, F.lit(False)), "kept").otherwise("refused")
    return indexes.join(newest, list(keys), "left").select(*keys, verdict.alias("verdict"))


def vector_problems(vectors: DataFrame, dim: int) -> DataFrame:
    """One row: number of vectors, of wrong sizes and of vectors with null elements."""
    v = F.col("embedding")
    return vectors.agg(
        F.count(F.lit(1)).alias("vectors"),
        F.count_if(v.isNull() | (F.size(v) != dim)).alias("wrong_size"),
        F.count_if(F.exists(v, lambda x: x.isNull())).alias("null_elements"),
    )


def require_dimension(vectors: DataFrame, dim: int) -> DataFrame:
    """Same rows; a vector of another size or with a null element fails the job when it is read."""
    v = F.col("embedding")
    good = v.isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull())
    return vectors.withColumn(
        "embedding", F.when(good, v).otherwise(F.raise_error(F.lit(f"vector does not fit dimension {dim}")))
    )


def _fits(value: object, kind: T.DataType, nullable: bool) -> bool:
    if value is None:
        return nullable
    if isinstance(kind, T.StructType):
        return isinstance(value, dict) and all(_fits(value.get(f.name), f.dataType, f.nullable) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return isinstance(value, list) and all(_fits(v, kind.elementType, kind.containsNull) for v in value)
    if isinstance(kind, T.StringType):
        return isinstance(value, str)
    if isinstance(kind, T.BooleanType):
        return isinstance(value, bool)
    if isinstance(value, bool):
        return False
    return isinstance(value, int) if isinstance(kind, T.IntegralType) else isinstance(value, (int, float))


def _valid_json(text: str | None, schema: T.StructType) -> bool:
    try:
        return _fits(json.loads(text or ""), schema, False)
    except ValueError:
        return False


class _Pause:
    """A delay that one caller was told of and all callers of a task keep."""

    def __init__(self, sleep: Callable[[float], None], clock: Callable[[], float] = time.monotonic):
        self.sleep, self.clock, self.until, self.lock = sleep, clock, 0.0, threading.Lock()

    def note(self, seconds: float) -> None:
        with self.lock:
            self.until = max(self.until, self.clock() + seconds)

    def wait(self) -> None:
        left = self.until - self.clock()
        if left > 0:
            self.sleep(left)


def _call(
    fn: Callable[..., str],
    args: tuple[str, ...],
    max_retries: int,
    sleep: Callable[[float], None],
    pause: _Pause | None = None,
) -> tuple[str | None, str, str | None, int]:
    """(response, outcome, error, calls made); transient failures are tried again with growing delay."""
    pause = pause or _Pause(sleep)
    for attempt in range(max_retries + 1):
        pause.wait()
        try:
            return fn(*args), "ok", None, attempt + 1
        except ModelError as e:
            if e.code not in RETRYABLE_CODES or attempt == max_retries:
                return None, e.outcome, str(e), attempt + 1
            if e.retry_after > 0:
                pause.note(e.retry_after * (1 + random.uniform(0, MAX_JITTER)))
            else:
                sleep(min(MAX_DELAY_S, BASE_DELAY_S * 2**attempt) * (1 + random.uniform(0, MAX_JITTER)))
        except Exception as e:  # whatever a model client raises is that row's outcome, not the job's end
            return None, "error", f"{type(e).__name__}: {e}", attempt + 1
    raise AssertionError("unreachable")


def batch_generate(
    df: DataFrame,
    prompt_cols: Sequence[str],
    generate_fn: Callable[..., str],
    schema: T.StructType | None = None,
    max_retries: int = MAX_RETRIES,
    sleep: Callable[[float], None] = time.sleep,
    concurrency: int = CONCURRENT_CALLS,
) -> DataFrame:
    """Apply a text model to every row; adds response, outcome, error, calls, tokens_in, tokens_out.

    ``generate_fn`` gets the prompt columns as strings, returns text and may raise
    :class:`ModelError`; it must be picklable and may be called by ``concurrency`` threads of a task at once. Results
    keep the order of the rows. A failure with a ``retry_after`` makes all callers of the task wait that long. With
    ``schema`` the response must be JSON of that shape; one more call is made when it is not, then the outcome is
    ``invalid_response``. Rows never fail the job. Input columns pass through
    as Arrow columns, untouched; a null prompt is sent as an empty string.
    """
    fn = generate_fn
    added = [
        T.StructField("response", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("calls", T.IntegerType()),
        T.StructField("tokens_in", T.IntegerType()),
        T.StructField("tokens_out", T.IntegerType()),
    ]

    def one(args: tuple[str, ...], pause: _Pause) -> tuple[object, ...]:
        text, outcome, error, calls = _call(fn, args, max_retries, sleep, pause)
        rounds = 1
        if schema is not None and outcome == "ok" and not _valid_json(text, schema):
            text, outcome, error, more = _call(fn, args, max_retries, sleep, pause)
            calls, rounds = calls + more, 2
            if outcome == "ok" and not _valid_json(text, schema):
                text, outcome, error = None, "invalid_response", "response does not fit the schema"
        words_in = sum(len(a.split()) for a in args) * rounds
        words_out = len(text.split()) if text and schema is None else 0
        return text, outcome, error, calls, words_in, words_out

    kept, names = len(df.columns), [*df.columns, *[f.name for f in added]]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pause = _Pause(sleep)
        with ThreadPoolExecutor(concurrency) as callers:
            for batch in batches:
                prompts = [tuple(sent.values()) for sent in batch.column(kept).to_pylist()]
                results = list(callers.map(lambda args: one(args, pause), prompts))
                columns = [pa.array([r[i] for r in results], kind) for i, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *columns], names=names)

    # The prompts ride in one more column, at the end, which does not come back.
    prompts = F.struct(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"p{i}") for i, c in enumerate(prompt_cols)]
    )
    sent = df.select("*", prompts.alias("_prompts"))
    return sent.mapInArrow(run, T.StructType([*df.schema.fields, *added]))


def generation_usage(generated: DataFrame, provider: str, model: str, by: Sequence[str] = ()) -> DataFrame:
    """Usage rows for what :func:`batch_generate` gave: tokens in and out of all rows, whatever their outcome."""
    return generated.groupBy(*by).agg(
        F.lit("llm").alias("kind"),
        F.lit(provider).alias("provider"),
        F.lit(model).alias("model"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
    )
