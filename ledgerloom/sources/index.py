"""The versioned vector index: rebuilt as a whole, published by one small write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.schemas import LIBRARY_TABLES


def publish(
    spark: SparkSession, out_dir: str, version: int, provider: str, model: str, dimension: int
) -> None:
    """Point readers at ``version``: write one ``index_meta`` row under its own folder.

    A reader sees the row only when its commit marker is there, so it never meets half a version.
    """
    row = spark.range(1).select(
        F.lit(version).cast("bigint").alias("id"),
        F.lit(provider).alias("embedding_provider"),
        F.lit(model).alias("embedding_model"),
        F.lit(dimension).cast("int").alias("dimension"),
        F.current_timestamp().alias("updated_at"),
    )
    row.coalesce(1).write.mode("errorifexists").parquet(f"{out_dir}/index_meta/v={version}")


def reindex(
    chunks: DataFrame,
    embedder: Callable[[DataFrame], DataFrame],
    out_dir: str,
    version: int,
    provider: str,
    model: str,
    dimension: int,
) -> None:
    """Embed all chunks anew into ``{out_dir}/vectors/v={version}`` and then publish that version.

    ``embedder`` adds an ``embedding`` column. Older versions stay until removed, so readers that
    began before the switch finish on the vectors they started with.
    """
    vectors = embedder(chunks)
    checked = vectors.withColumn(
        "embedding",
        F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(
            F.raise_error(F.lit(f"embedding size differs from {dimension}"))
        ),
    )
    checked.write.mode("errorifexists").parquet(f"{out_dir}/vectors/v={version}")
    publish(chunks.sparkSession, out_dir, version, provider, model, dimension)


def read_index_meta(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema(LIBRARY_TABLES["index_meta"]).parquet(f"{out_dir}/index_meta")


def read_published(spark: SparkSession, out_dir: str) -> DataFrame:
    """Vectors of the newest published version (reads one pointer row first)."""
    version = read_index_meta(spark, out_dir).agg(F.max("id")).first()[0]
    if version is None:
        raise ValueError(f"no published version in {out_dir}")
    return spark.read.parquet(f"{out_dir}/vectors/v={version}")
