"""The best chunks per dimension and document: against a plain ranking, with ties, zeros and nulls, without texts in the pairs."""

from __future__ import annotations

import numpy as np
import pytest

from ledgerloom.operators.search import retrieve_by_dimension

SCHEMA = "id string, document_id string, user_id string, text string, chunk_index int, embedding array<double>"


def test_equal_to_a_plain_ranking(spark):
    rng = np.random.default_rng(2)
    rows = [(f"c{i:04d}", f"d{i % 5}" if i % 3 else "hot", "u", f"text {i}", i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(600)]
    rows += [("z1", "d9", "u", "t", 0, [0.0] * 4), ("z2", "d9", "u", "t", 0, None), ("z0", "d9", "u", "t", 0, None), ("n", None, "u", "t", 0, [1.0, 0.0, 0.0, 0.0])]
    dimensions = {"a": [1.0, 2.0, 0.0, 0.0], "b": [0.0, -1.0, 1.0, 1.0], "zero": [0.0] * 4}
    got = retrieve_by_dimension(dimensions, spark.createDataFrame(rows, SCHEMA).repartition(6), None, 3)
    assert got.columns == ["id", "document_id", "text", "dimension", "score", "rank"]
    found = {(r["dimension"], r["document_id"], r["rank"]): (r["id"], r["score"], r["text"]) for r in got.collect()}

    def score(v, w):
        if v is None or not any(v) or not any(w):
            return None
        return round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 6) + 0.0

    want = {}
    for name, vector in dimensions.items():
        for document in {r[1] for r in rows}:
            scored = [(score(r[5], vector), r[0], r[3]) for r in rows if r[1] == document]
            scored.sort(key=lambda s: (s[0] is None, -(s[0] or 0), s[1]))
            want |= {(name, document, i): (c, s, t) for i, (s, c, t) in enumerate(scored[:3], 1)}
    assert found == want


def test_pairs_are_not_rows(spark):
    rows = [(f"c{i}", "d", "u", "t", i, [1.0, float(i)]) for i in range(50)]
    plan = retrieve_by_dimension({"a": [1.0, 0.0], "b": [0.0, 1.0]}, spark.createDataFrame(rows, SCHEMA), None, 2)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in text and "MapInArrow" in text
    with pytest.raises(Exception, match="must have 3"):
        retrieve_by_dimension({"a": [1.0, 0.0, 0.0]}, spark.createDataFrame(rows, SCHEMA), None, 2).collect()
