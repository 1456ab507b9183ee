"""Bucketed tables: updates touch their buckets only, failures leave the old version."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.maintenance import delete_by_document, upsert
from ledgerloom.sources import buckets as b

SCHEMA = "id string, value int, note string"


def files(spark, table):
    return {(r[0], r[1]) for r in table.read().select(F.input_file_name(), F.spark_partition_id() * 0).distinct().collect()}


def rows(df):
    return sorted(map(str, df.collect()))


def test_updates_touch_their_buckets(spark, tmp_path):
    rng = random.Random(1)
    old = spark.createDataFrame([(f"k{i}", i, None) for i in range(4000)] + [(None, 1, "x")], SCHEMA)
    table = b.create_buckets(old, str(tmp_path / "t"), "id", 64)
    assert rows(table.read()) == rows(old)
    before = files(spark, table)
    updates = spark.createDataFrame([(f"k{i}", -i, "new") for i in rng.sample(range(4000), 8)] + [("fresh", 7, None)], SCHEMA)
    after = b.upsert_buckets(table, updates)
    assert rows(after.read()) == rows(upsert(old, updates))
    touched = set(table.touched(updates.select("id")))
    assert 1 < len(touched) <= 9 and len(before & files(spark, after)) == len(before) - len(touched & set(table.folders))
    assert {k for k, f in after.folders.items() if table.folders.get(k) != f} == touched and after.version == 1
    gone = spark.createDataFrame([("k5",), ("fresh",), ("absent",)], "id string")
    less = b.delete_buckets(after, gone)
    assert rows(less.read()) == rows(delete_by_document(after.read(), gone, "id")) and less.version == 2
    # Readers that began earlier still see their version.
    assert rows(table.read()) == rows(old)
    nothing = b.upsert_buckets(less, updates.limit(0))
    assert nothing.version == 2
    empty = b.delete_buckets(less, less.read().select("id"))
    assert empty.read().count() == 1


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.range(100).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("value"), F.lit("a").alias("note"))
    table = b.create_buckets(old, path, "id", 8)
    broken = spark.createDataFrame([("1", 5, "z")], SCHEMA).withColumn("note", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        b.upsert_buckets(table, broken)
    again = b.BucketedTable(spark, path)
    assert again.version == 0 and rows(again.read()) == rows(old)
    assert rows(b.upsert_buckets(again, old.limit(0).union(spark.createDataFrame([("1", 5, "z")], SCHEMA))).read().filter("value = 5")) == ["Row(id='1', value=5, note='z')"]
    with pytest.raises(ValueError, match="not to be rewritten"):
        other = b.create_buckets(old, str(tmp_path / "u"), "id", 8)
        other.rewrite(old, [0])
    assert rows(b.BucketedTable(spark, str(tmp_path / "u")).read()) == rows(old)
    with pytest.raises(ValueError, match="buckets"):
        b.create_buckets(old, path + "x", "id", 0)
