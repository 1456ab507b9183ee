"""Tables in key buckets: an update rewrites the buckets it touches and is published by one small write.

``{path}/data/F/bucket=B`` holds the rows that one write, of a folder F of its own, made for bucket B;
``{path}/manifest/v=N`` says in which folder version N finds each bucket. What a failed write left is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.maintenance import delete_by_document, upsert

MAX_BUCKETS = 4096
MANIFEST = "bucket int, folder string, key string, buckets int, columns string"


class BucketedTable:
    """The newest published version of a bucketed table."""

    def __init__(self, spark: SparkSession, path: str):
        rows = spark.read.schema(f"{MANIFEST}, v bigint").parquet(f"{path}/manifest")
        newest = rows.agg(F.max("v")).first()[0]
        if newest is None:
            raise ValueError(f"no published version in {path}")
        # At most one row per bucket, and one without a bucket for the layout.
        held = rows.filter(F.col("v") == newest).collect()
        layout = next(r for r in held if r["bucket"] is None)
        self.spark, self.path, self.version = spark, path, newest
        self.key, self.buckets = layout["key"], layout["buckets"]
        self.schema = T.StructType.fromJson(json.loads(layout["columns"]))
        self.folders = {r["bucket"]: r["folder"] for r in held if r["bucket"] is not None}

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows, or those of the given buckets only; other folders are not listed."""
        wanted = sorted(self.folders if buckets is None else set(buckets) & set(self.folders))
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/data/{self.folders[b]}/bucket={b}" for b in wanted]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def bucket_of(self, key: Column | str) -> Column:
        return _bucket(F.col(key) if isinstance(key, str) else key, self.buckets)

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of the first column of ``keys``; at most ``MAX_BUCKETS`` rows reach the driver."""
        found = keys.select(self.bucket_of(F.col(keys.columns[0])).alias("bucket")).distinct()
        return sorted(r["bucket"] for r in found.collect())

    def rewrite(self, rows: DataFrame, buckets: Sequence[int]) -> BucketedTable:
        """Publish a version in which ``rows`` are all there is in ``buckets``; others keep their files."""
        folder = _write(rows, self.path, self.key, self.buckets)
        written = _written(self.spark, self.path, folder, self.schema)
        if not written <= set(buckets):
            raise ValueError(f"rows for buckets {sorted(written - set(buckets))[:5]} that are not to be rewritten")
        kept = {b: f for b, f in self.folders.items() if b not in set(buckets)}
        _publish(self.spark, self.path, self.version + 1, self.key, self.buckets, self.schema, kept | dict.fromkeys(written, folder))
        return BucketedTable(self.spark, self.path)


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, key: str, buckets: int) -> str:
    folder = f"write-{uuid.uuid4().hex}"
    placed = rows.withColumn("bucket", _bucket(F.col(key), buckets)).repartition("bucket")
    placed.write.mode("errorifexists").partitionBy("bucket").parquet(f"{path}/data/{folder}")
    return folder


def _written(spark: SparkSession, path: str, folder: str, schema: T.StructType) -> set[int]:
    """Buckets that a write made, from its folders alone."""
    whole = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    found = spark.read.schema(whole).parquet(f"{path}/data/{folder}").select("bucket").distinct()
    return {r["bucket"] for r in found.collect()}


def _publish(
    spark: SparkSession, path: str, version: int, key: str, buckets: int, schema: T.StructType, folders: dict[int, str]
) -> None:
    rows = [(None, None, key, buckets, schema.json()), *[(b, f, key, buckets, None) for b, f in sorted(folders.items())]]
    # Two writers of one version cannot both succeed, and readers see a manifest only when it is whole.
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest/v={version}")


def create_buckets(rows: DataFrame, path: str, key: str, buckets: int = 256) -> BucketedTable:
    """Write ``rows`` as version 0 of a table bucketed by ``key``; no column may be called ``bucket``."""
    if not 1 <= buckets <= MAX_BUCKETS:
        raise ValueError(f"need 1 to {MAX_BUCKETS} buckets")
    if "bucket" in rows.columns:
        raise ValueError("a column is called bucket")
    folder = _write(rows, path, key, buckets)
    written = _written(rows.sparkSession, path, folder, rows.schema)
    _publish(rows.sparkSession, path, 0, key, buckets, rows.schema, dict.fromkeys(written, folder))
    return BucketedTable(rows.sparkSession, path)


def upsert_buckets(table: BucketedTable, updates: DataFrame, order_by: Sequence[str | Column] = (), key: str | None = None) -> BucketedTable:
    """:func:`upsert` that reads and rewrites only the buckets of the updated keys.

    ``key`` identifies a row where that is not the layout's key; a row must then never change its layout key.
    """
    buckets = table.touched(updates.select(table.key))
    return table.rewrite(upsert(table.read(buckets), updates, key or table.key, order_by), buckets) if buckets else table


def delete_buckets(table: BucketedTable, ids: DataFrame) -> BucketedTable:
    """:func:`delete_by_document` by the layout's key that reads and rewrites only the buckets of the given ids."""
    buckets = table.touched(ids)
    return table.rewrite(delete_by_document(table.read(buckets), ids, table.key), buckets) if buckets else table
