"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import written

# A node's neighbours are joined with its minimum in this many parts, so that a star's centre is no hot key.
PARTS = 8


def star(pairs: DataFrame, keep_smaller: bool) -> DataFrame:
    """For each node u the edges from its neighbours v to the least node around u.

    ``pairs`` holds (u, v) rows. Large-star gets both directions and keeps the neighbours above u;
    small-star gets the directed pairs v < u and keeps all of them and u itself.
    """
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    salted = pairs.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int"))
    spread = least.withColumn("part", F.explode(F.array(*map(F.lit, range(PARTS)))))
    joined = salted.join(spread, ["u", "part"])
    if keep_smaller:
        edges = joined.select("v", "m").union(least.select(F.col("u").alias("v"), "m"))
    else:
        edges = joined.where("v > u").select("v", "m")
    return edges.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (two bigint columns a and b); component is the least node.

    Each round makes every node point at the least node it knows of: large-star links larger
    neighbours, small-star links smaller ones. Edges are directed from larger to smaller. Rounds go
    on until the edges stay the same, about the logarithm of a component's diameter; each round is
    written to the shared folder, so its cost and its recovery do not depend on the rounds before.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = written(now, "edges")
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    seen = now.agg(F.count("*"), mark).first()
    while seen[0]:
        large = star(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), keep_smaller=False)
        now = written(star(large, keep_smaller=True), "edges")
        got = now.agg(F.count("*"), mark).first()
        if got == seen:
            break
        seen = got
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
