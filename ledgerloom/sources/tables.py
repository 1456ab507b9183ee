"""Typed scans of library tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerloom.schemas import LIBRARY_TABLES


def read_table(
    spark: SparkSession,
    directory: str,
    name: str,
    schema: T.StructType | str | None = None,
    spread: bool = False,
) -> DataFrame:
    """Scan ``{directory}/{name}.parquet`` (a file or a folder) with its declared schema.

    The schema is never inferred, so no file footer is read at planning time, and timestamps
    stored without a zone are read as UTC instants. With ``spread``, a table stored in fewer splits
    than there are cores is dealt out to all of them, for work that is heavy per row; a table with
    enough splits is left where it is.
    """
    if schema is None:
        if name not in LIBRARY_TABLES:
            raise KeyError(f"no declared schema for table {name!r}")
        schema = LIBRARY_TABLES[name]
    table = spark.read.schema(schema).parquet(f"{directory.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    # Asking a plain scan for its partitions plans it but runs nothing.
    return table.repartition(cores) if spread and table.rdd.getNumPartitions() < cores else table


def write_table(
    df: DataFrame, directory: str, name: str, partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> str:
    """Write a library table where :func:`read_table` finds it; returns the path."""
    path = f"{directory.rstrip('/')}/{name}.parquet"
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return path
