"""Running a streaming query over everything that is available, into a table, and closing a stream."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import shared_dir

# Fixed value: the state store that keyed state with timers needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Marks the row that closes a stream: its time moves the watermark, and it is in no result.
CLOSING = "_closing"


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of the same application set up for keyed state; the caller's settings stay as they are."""
    session = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.checkpoint.dir"):
        value = spark.conf.get(name, None)
        if value is not None and session.conf.isModifiable(name):
            session.conf.set(name, value)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return session


def closable(schema: T.StructType | str) -> T.StructType:
    """The schema of a stream of files that :func:`write_closing` can close."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return T.StructType([*fields.fields, T.StructField(CLOSING, T.BooleanType())])


def write_closing(
    spark: SparkSession, folder: str, schema: T.StructType | str, time: str, at: dt.datetime
) -> None:
    """Add a last file to a stream of Parquet files: one row with nothing but its time ``at``.

    Once it has been read, the watermark has passed every earlier time, so that all windows, buffers and
    states come to their end. ``at`` must lie behind the last row by more than the operator's watermark (and expiry).
    """
    row = spark.createDataFrame([(at, True)], f"{time} timestamp, {CLOSING} boolean")
    columns = [F.col(f.name) if f.name in row.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in closable(schema)]
    row.select(*columns).coalesce(1).write.mode("append").parquet(folder)


def watermarked(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """``stream`` with its watermark, without a closing row."""
    marked = stream.withWatermark(time, delay)
    if CLOSING not in stream.columns:
        return marked
    # Naming the time, in a way that is always true, keeps the filter behind the watermark, which the closing row must move.
    ordinary = ~(F.coalesce(F.col(CLOSING), F.lit(False)) & (F.unix_micros(F.col(time).cast("timestamp")) > -(1 << 62)))
    return marked.filter(ordinary).drop(CLOSING)


def run_available(stream: DataFrame, label: str, mode: str = "append", path: str | None = None) -> str:
    """Process all available input, then stop; returns the Parquet folder with the output rows.

    Append mode uses the file sink, which commits each batch once. In update mode every batch
    overwrites its own folder, so a replayed batch leaves the same rows. How many rows came later than the
    watermark, and how many rows of state are left, is told by :func:`late_rows`.
    """
    base = path or shared_dir(stream.sparkSession, label)
    out = f"{base}/rows"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").outputMode("append").start(out)
    else:

        def save(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

        query = writer.foreachBatch(save).outputMode(mode).start()
    query.awaitTermination()
    # One row per batch and operator with state, as the query reports them.
    rows = [
        (p["batchId"], i, s["numRowsDroppedByWatermark"], s["numRowsTotal"])
        for p in query.recentProgress
        for i, s in enumerate(p["stateOperators"])
    ]
    counts = stream.sparkSession.createDataFrame(rows, "batch_id bigint, operator int, late bigint, state_rows bigint")
    counts.coalesce(1).write.mode("append").parquet(f"{base}/late")
    return out


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """Per batch and operator with state: rows dropped as ``late``, and ``state_rows`` left behind the batch."""
    return spark.read.parquet(f"{out.rsplit('/', 1)[0]}/late")
