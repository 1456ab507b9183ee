"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import written

# Rows that one task orders; the number of blocks follows from the number of rows. The driver draws and sends one
# row of the matrix per block, so beyond this many blocks they get longer instead.
BLOCK_ROWS, MOST_BLOCKS = 20_000, 1 << 16


def take_places(left: np.ndarray, rows: int, random: np.random.Generator) -> np.ndarray:
    """One multivariate hypergeometric draw: ``rows`` of the places left, counted by shard."""
    total = int(left.sum())
    if total < 10**9:  # what the library's method allows
        return random.multivariate_hypergeometric(left, rows, method="marginals")
    places = np.empty(0, dtype=np.int64)
    while len(places) < rows:
        places = np.unique(np.concatenate([places, random.integers(total, size=rows - len(places))]))
    return np.bincount(np.searchsorted(np.cumsum(left), places, side="right"), minlength=len(left))


def communication_matrix(block_rows: list[int], shard_rows: list[int], seed: int) -> np.ndarray:
    """How many rows of each block go to each shard in a uniformly random assignment.

    Rows of the matrix are drawn one after another from the multivariate hypergeometric distribution
    of the places that are left, so that block and shard sums come out exactly.
    """
    random = np.random.default_rng(seed)
    left = np.array(shard_rows, dtype=np.int64)
    out = np.zeros((len(block_rows), len(shard_rows)), dtype=np.int64)
    for i, rows in enumerate(block_rows):
        if rows:
            out[i] = take_places(left, rows, random)
            left -= out[i]
    return out


def shard_rows(df: DataFrame, key_cols: list[str], shards: int = 8, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards - 1``) and ``slot`` (gapless from 0 within the shard).

    Shard sizes differ by at most one row, and both the choice of rows and their order are a uniform
    shuffle for the given seed. Rows are dealt into blocks by a hash of ``key_cols``; the driver draws
    the exact matrix of counts between blocks and shards (its size is rows / ``block_rows``, 65,536 at most, times
    ``shards``); each block is permuted locally and cut by its row of the matrix; after the exchange
    each shard is permuted again, in sub-blocks by the leading bits of a second random key.

    ``key_cols`` must tell rows apart well enough that no value of them fills a block; rows that agree
    in all of them meet in one block and stand next to one another. Nulls are keys like any other value. An empty table stays empty. A
    column called ``shard`` or ``slot`` must be renamed before.
    """
    taken = {"shard", "slot"} & set(df.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are in the way")
    count = df.count()
    blocks = min(MOST_BLOCKS, max(1, -(-count // block_rows)))
    draw = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), *key_cols)
    # The caller's columns travel as one, so none of them can meet a name used here.
    keyed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
        F.pmod(draw("block"), F.lit(blocks)).cast("int").alias("_block"),
        draw("first").alias("_first"),
        draw("second").alias("_second"),
    )
    counts = {r["_block"]: r["count"] for r in keyed.groupBy("_block").count().collect()}
    sizes = [counts.get(i, 0) for i in range(blocks)]
    matrix = communication_matrix(sizes, [count // shards + (s < count % shards) for s in range(shards)], seed)
    spark = df.sparkSession
    cuts = spark.createDataFrame(
        [(i, [int(c) for c in np.cumsum(matrix[i])]) for i in range(blocks)], "_block int, _cuts array<bigint>"
    )
    # One row per block joins each block: the local permutation, cut at the running sums.
    place = F.row_number().over(Window.partitionBy("_block").orderBy("_first", "_second"))
    dealt = keyed.withColumn("_place", place).join(cuts, "_block")
    dealt = written(
        dealt.withColumn("shard", F.size(F.filter("_cuts", lambda c: c < F.col("_place"))).cast("int")).drop(
            "_cuts", "_place", "_block", "_first"
        ),
        "shards-dealt",
    )
    subs = max(1, blocks // shards)
    dealt = dealt.withColumn("_sub", F.pmod(F.shiftrightunsigned("_second", 20), F.lit(subs)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "_sub").count().select(
        "shard", "_sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")
    )
    within = F.row_number().over(Window.partitionBy("shard", "_sub").orderBy("_second"))
    placed = dealt.withColumn("_within", within).join(starts, ["shard", "_sub"])
    return placed.select("_row.*", "shard", (F.col("_start") + F.col("_within") - 1).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the rows of each shard into a folder of its own, ordered by slot within every file."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
