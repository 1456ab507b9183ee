"""Findings of the fourth round: what travels between tasks, and that the rows stay the same."""

from __future__ import annotations

import datetime as dt
import re

import numpy as np
from pyspark.sql import functions as F

from checks.inputs import SCHEMAS, Inputs
from ledgerloom.operators import compare, pq, topk


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df, *columns):
    return sorted(map(str, df.select(*(columns or df.columns)).collect()))


def _line(part, supplier, number, price, flag, day):
    return (None, part, supplier, number, 1.0, price, 0.05, 0.02, flag, "F", day)


def _library(spark, folder, vectors=0):
    """Order lines of three parts over quarters, with lines that come twice and with nulls, and some vectors."""
    day = lambda m: dt.datetime(1995, m, 3)
    lines = [_line(p, s, n, 100.5 * p + n, "RAN"[n % 3], day(m)) for p in (1, 2, 6) for s in (7, 8) for n in (1, 2) for m in (1, 2, 5, 11)]
    odd = [_line(None, 7, 1, 3.0, "R", day(1)), _line(1, None, 2, 4.0, None, day(1)), _line(2, 7, None, 5.0, "A", None), _line(1, 8, 3, None, "R", day(5))]
    frame = spark.createDataFrame([*lines, *lines[:5], *odd], SCHEMAS["lineitem"])
    frame.write.parquet(f"{folder}/lineitem.parquet")
    embeddings = [(i, [float((i + j) % 5) for j in range(64)], i % 2) for i in range(vectors)]
    spark.createDataFrame(embeddings, SCHEMAS["embeddings"]).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_lines_travel_once_for_figures_and_segments(spark, tmp_path):
    """the figures of a company's reports and their segments are made where its order lines lie."""
    t = Inputs(spark, _library(spark, tmp_path))
    joined = t.report_metrics.withColumn("segment", F.lit(None).cast("string")).unionByName(t.report_segments.withColumn("metric", F.lit("segment_revenue")))
    assert _rows(t.company_all_metrics) == _rows(joined, *t.company_all_metrics.columns)
    assert _rows(t.company_metrics) == _rows(t.report_metrics)
    import __spark_entry__ as driver

    deltas = driver.queries()["f3_metric_deltas"](spark, str(tmp_path))
    # Once for the lines that are compared, once for those without a part or a day.
    assert _plan(deltas).count("Exchange hashpartitioning") == 2 and "Join" not in _plan(deltas)


def test_lines_are_dealt_to_tasks_by_their_number(spark, tmp_path, monkeypatch):
    """a task's lines stay few however many there are."""
    monkeypatch.setattr(Inputs, "LINES_OF_A_TASK", 2, raising=False)
    t = Inputs(spark, _library(spark, tmp_path))
    assert t.company_figures.rdd.getNumPartitions() == -(-t.table("lineitem").count() // 2)
    assert _rows(t.company_figures) == _rows(t.report_figures)


def test_only_comparisons_with_evidence_travel(spark, tmp_path):
    """deltas whose comparison has no evidence are put together where they lie; the records stay the same."""
    reports = [(f"{c}-{q}", c, f"2024Q{q}") for c in ("a", "b") for q in (1, 2, 4)] + [(None, "a", "2024Q3"), (None, "b", "2024Q3"), ("n", None, "2024Q1"), ("m", "a", None)]
    rows = [(*r, m, None if (i, m) == (1, "taxes") else i, "units", "USD") for i, r in enumerate(reports) for m in ("revenue", "taxes")]
    metrics = spark.createDataFrame(rows, "document_id string, company string, fiscal_period string, metric string, value int, unit string, currency string")
    metrics = metrics.withColumn("value", F.col("value").cast("decimal(28,4)"))
    ordinal = compare.quarter_ordinal(F.col("fiscal_period"))
    deltas = compare.period_deltas(metrics.repartition(4, "company"), ordinal, together=True).withColumn("comparison_id", F.col("document_id"))
    told = [("a-2", "a-2", "k1", 0.5), ("a-2", "a-2", "k2", 0.25), ("x", "x", "k3", 0.5), (None, "y", "k4", 0.5)]
    for found in (told, []):
        evidence = spark.createDataFrame(found, "comparison_id string, document_id string, chunk_id string, score double")
        before = compare.comparison_result(deltas, evidence)
        kept = compare.comparison_result(deltas, evidence, together=["company"])
        assert _rows(kept) == _rows(before)
        assert "keys=[company" in _plan(kept) and _plan(kept).count("Exchange hashpartitioning(company") == _plan(deltas).count("Exchange hashpartitioning(company") * 2
    evidence = spark.createDataFrame(told, evidence.schema)
    two = evidence.withColumn("kind", F.lit("k"))
    both = [deltas.withColumn("kind", F.when(F.col("metric") == "taxes", "k")), two]
    assert _rows(compare.comparison_result(*both, ["comparison_id", "kind"], ["company"])) == _rows(compare.comparison_result(*both, ["comparison_id", "kind"]))
    import __spark_entry__ as driver

    records = driver.queries()["f9_comparison_result"](spark, _library(spark, tmp_path, vectors=3))
    assert "keys=[company" in _plan(records) and {r["part"] for r in records.collect()} == {"table", "evidence"}


def test_codes_meet_their_owners_questions_in_large_blocks(spark, monkeypatch):
    """codes travel to blocks of their owner's questions, estimates once; blocks and owners change no rows."""
    rng = np.random.default_rng(5)
    data = [[float(x) for x in v] for v in rng.normal(size=(240, 8)).astype(np.float32)]
    owners = ["a", "b", None, "c"]
    vectors = spark.createDataFrame([(i, f"d{i % 3}" if i % 5 else None, owners[i % 4], v) for i, v in enumerate(data)], "id long, document_id string, user_id string, embedding array<float>")
    asked = [(i, owners[i % 4], v, ["d1"] if i % 6 == 0 else None) for i, v in enumerate(data[:80])] + [(99, "nobody", data[0], None)]
    questions = spark.createDataFrame(asked, "qid long, user_id string, embedding array<float>, document_ids array<string>")
    index = pq.build_pq(vectors, n_lists=6, parts=4)
    whole = pq.pq_search(questions, index, vectors, 4, n_probe=6, rerank=60)
    plan = _plan(whole)
    assert "_own" in plan and not re.search(r"hashpartitioning\(qid#\d+L, id#", plan)
    rows = whole.collect()
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for qid, owner, v, scope in asked:
        mine = [(round(float(unit(v) @ unit(w)), 6), i) for i, w in enumerate(data) if owners[i % 4] == owner and (scope is None or (i % 5 and f"d{i % 3}" in scope))]
        best = sorted(mine, key=lambda s: (-s[0], s[1]))[:4]
        assert [r["id"] for r in sorted((r for r in rows if r["qid"] == qid), key=lambda r: r["rank"])] == [i for _, i in best]
    for name, size in (("CODE_BLOCK", 50), ("ASK_BLOCK", 7), ("QUESTION_BLOCK", 5), ("OWNERS", 2)):
        monkeypatch.setattr(pq, name, size)
    doubles = [df.withColumn("embedding", F.col("embedding").cast("array<double>")) for df in (questions, vectors)]
    assert _rows(pq.pq_search(questions, index, vectors, 4, n_probe=6, rerank=60)) == _rows(whole) == _rows(pq.pq_search(doubles[0], index, doubles[1], 4, n_probe=6, rerank=60))


def test_vectors_travel_to_few_blocks_of_questions(spark, monkeypatch):
    """blocks of questions grow before a group has many, as its vectors travel once per block."""
    monkeypatch.setattr(topk, "MOST_BLOCKS", 2)
    monkeypatch.setattr(topk, "FULL_QUESTIONS", 50)
    rows = [(i, "u", [float(i % 7 + 1), float(i % 3)]) for i in range(150)]
    vectors = spark.createDataFrame(rows, "id long, user_id string, embedding array<float>").withColumn("document_id", F.lit("d"))
    questions = vectors.select(F.col("id").alias("qid"), "user_id", "embedding", F.lit(None).cast("array<string>").alias("document_ids"))
    sent = topk.topk_join(questions, vectors, ["user_id"], 3)
    assert _rows(topk.topk_join(questions, vectors, ["user_id"], 3, max_sent=0, q_block=10)) == _rows(sent)
    held = []
    monkeypatch.setattr(topk, "rows_if_bounded", lambda df: held.append([r.asDict() for r in df.collect()]) or df.collect())
    topk.topk_join(questions, vectors, ["user_id"], 3, max_sent=0, q_block=10)
    assert [g["_nq"] for some in held for g in some if "_nq" in g] == [3]
