"""Hard negatives against a plain search, on ties, copies, odd vectors and a hot direction."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import hard_negatives
from ledgerloom.llm.hard_negatives import hard_negatives as mine

SCHEMA = "vec_id bigint, label int, embedding array<double>, row int, block int, score string"


def plain(rows, asks):
    usable = []
    for i, label, vector in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        usable.append((i, label, [math.floor(256 * x) for x in vector]))
    product = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, label, vector in usable:
        if not asks(a):
            continue
        scored = sorted(((product(vector, v), i, y) for i, y, v in usable if i != a), key=lambda t: (-t[0], t[1]))
        for score, i, _ in [t for t in scored if t[2] == label][:5]:
            fits = [t for t in scored if t[2] != label and 50 * score <= 100 * t[0] <= 95 * score][:3]
            out += [(a, i, rank + 1, j, score, s) for rank, (s, j, _) in enumerate(fits)]
    return sorted(out)


def run(spark, rows, asks, **how):
    table = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in mine(table, asks, **how).collect())


def vectors(n, rng, hot=0):
    centre = rng.normal(size=(4, 8))
    out = []
    for i in range(n):
        v = centre[i % 4] + rng.normal(size=8) * 0.4
        out.append((i, i % 3, (v / 4).round(2).tolist()))
    return out + [(n + i, i % 2, out[0][2]) for i in range(hot)]


def test_equal_to_a_plain_search(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = vectors(400, rng, hot=120)
    rows += [(1000, None, [0.1] * 8), (1001, 1, None), (1002, 1, [0.1, None] * 4), (1003, 1, [math.nan] * 8), (1004, 2, [math.inf] * 8)]
    rows += [(1005, 1, [0.0] * 8), (1010, 2, [0.0] * 8), (1006, 0, [0.5, 0.25]), (1007, 1, []), (None, 1, [0.3] * 8), rows[7], rows[7], rows[12]]
    random.Random(5).shuffle(rows)
    want = plain(rows, lambda i: i % 10 == 0)
    assert want
    monkeypatch.setattr(hard_negatives, "STRIDE", 16)
    for block_rows in (64, 100_000):
        assert run(spark, rows, F.col("id") % 10 == 0, block_rows=block_rows) == want


def test_few_rows(spark):
    assert run(spark, [], F.col("id") == 1) == []
    assert run(spark, [(1, 1, None)], F.col("id") == 1) == []
    assert run(spark, [(1, 1, [0.5]), (2, 1, [0.5]), (3, 2, [0.4])], F.col("id") == 1) == [(1, 2, 1, 3, 128 * 128, 128 * 102)]
    with pytest.raises(ValueError, match="too long"):
        run(spark, [(1, 1, [1e9]), (2, 1, [0.5])], F.col("id") == 1)


def test_lists_end_early():
    """Members leave a list once its bounds are below what they hold."""
    rng = np.random.default_rng(1)
    vectors = np.floor(rng.normal(size=(4000, 6)) * 100)
    plan = hard_negatives.Plan(hard_negatives.units(vectors[:1]), 6)
    plan.reach[0] = 0.05
    block = hard_negatives.Block(plan, np.arange(4000), np.zeros(4000, np.int64), vectors)
    _, bound = block.list_of(0)
    norm = np.linalg.norm(vectors[0])
    scores = np.sort(vectors @ vectors[0])[::-1]
    assert np.all(np.diff(bound) <= 0) and np.all(norm * bound + 0.5 >= vectors[block.order] @ vectors[0])
    assert np.searchsorted(-(norm * bound + 0.5), -scores[6]) < 2000
