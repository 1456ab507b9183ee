"""Streaming ingest: new report texts become chunks and vectors, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.layout import chunk_with_tables
from ledgerloom.operators.models import hash_embed
from ledgerloom.operators.rows import keep_first
from ledgerloom.operators.text import chunk_documents, tables_to_markdown
from ledgerloom.session import rows_if_bounded


def stream_ingest(
    spark: SparkSession,
    src_dir: str,
    index_dir: str,
    schema: T.StructType | str,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    embed: Callable[[DataFrame], DataFrame] = hash_embed,
    max_files_per_trigger: int = 1000,
    glob: str = "*.parquet",
    order_by: Sequence[str] = (),
    cells: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Start ingesting all documents that arrive in ``src_dir``; stops when none is left.

    A document is (id, user_id, company, fiscal_period, report_type, text) after ``prepare``. Every
    batch is chunked and embedded and overwrites its own folders, so a replayed batch leaves the
    same result. A document that comes again replaces all chunks of its earlier version, which
    :func:`read_stream_index` resolves: an append per batch instead of a rewrite of the index. Of
    rows with one id in one batch the last by ``order_by`` counts (ties: by content); texts are
    shuffled for that only in batches that hold such rows. ``cells`` gives the table cells of a batch's
    documents, which are then chunked where they stand.
    """
    arriving = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .option("pathGlobFilter", glob)
        .parquet(src_dir)
    )

    def ingest(batch: DataFrame, batch_id: int) -> None:
        docs = prepare(batch) if prepare is not None else batch
        again = docs.groupBy("id").count().filter("count > 1")
        if not again.isEmpty():
            content = F.xxhash64(*[c for c in docs.columns if c != "id"])
            docs = keep_first(docs, ["id"], [*[F.col(c).desc() for c in order_by], content])
        # A document without words has no chunks, yet it replaces those it had.
        docs.select(F.col("id").alias("document_id")).write.mode("overwrite").parquet(f"{index_dir}/documents/batch_id={batch_id}")
        # The facts ride along with each document, so enriching needs no join.
        facts = ("user_id", "company", "fiscal_period", "report_type")
        if cells is None:
            chunks = chunk_documents(docs, keep=facts)
        else:
            chunks = chunk_with_tables(docs, tables_to_markdown(cells(docs)), keep=facts)
        embed(chunks).write.mode("overwrite").parquet(f"{index_dir}/chunks/batch_id={batch_id}")

    return (
        arriving.writeStream.foreachBatch(ingest)
        .option("checkpointLocation", f"{index_dir}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def read_stream_index(spark: SparkSession, index_dir: str) -> DataFrame:
    """The index: for every document the chunks of the newest batch that held it.

    Documents that came more than once are found from ids alone. When they are few (one bounded job
    finds out) they are broadcast, so texts and vectors are read without a shuffle.
    """
    rows = spark.read.parquet(f"{index_dir}/chunks")
    again = (
        spark.read.parquet(f"{index_dir}/documents")
        .groupBy("document_id")
        .agg(F.max("batch_id").alias("_newest"), F.count(F.lit(1)).alias("_times"))
        .filter("_times > 1")
        .drop("_times")
    )
    few = rows_if_bounded(again)
    if few is not None:
        again = F.broadcast(spark.createDataFrame(few, again.schema))
    joined = rows.join(again, "document_id", "left").select(*rows.columns, "_newest")
    return joined.filter(F.col("_newest").isNull() | (F.col("batch_id") == F.col("_newest"))).drop("batch_id", "_newest")
