"""Small helpers around the session: shared scratch paths, checkpoints, size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A side is broadcast only when it is known to hold at most this many rows.
BROADCAST_ROWS = 4096


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the cluster's shared folder (``spark.checkpoint.dir``).

    A machine-local folder is used only when the session names none and runs in local mode.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="ledgerloom-")
    return f"{base.rstrip('/')}/ledgerloom/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoint"))
    return df.checkpoint()


def rows_if_bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS):
    """The rows of ``df`` if there are at most ``max_rows``, else ``None``.

    Runs one job that fetches at most ``max_rows + 1`` rows.
    """
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None
