"""Operators on tables that grow: rows as before, with less moved."""

from __future__ import annotations

import contextlib
import io
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import compare, pq, search, temporal, topk


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture
def figures(spark):
    schema = "document_id string, company string, fiscal_period string, metric string, segment string, value decimal(28,4), unit string, currency string"

    def rows(*specs):
        return spark.createDataFrame([(*s[:5], None if s[5] is None else D(s[5]), "units", "USD") for s in specs], schema)

    return rows


def test_period_deltas_move_a_report_once(figures):
    """Long reports, repeated and null names, two reports of a quarter, and nulls in what places a report."""
    specs = [(f"d{q}", "c", f"2025Q{q}", "seg", f"s{i}", i * q) for q in (1, 2) for i in range(q, 400, q)]
    specs += [("d1", "c", "2025Q1", "rev", None, 5), ("d1", "c", "2025Q1", "rev", None, 6), ("d2", "c", "2025Q2", "rev", None, 7)]
    specs += [("d2b", "c", "2025Q2", None, "s1", 8), (None, "c", "2025Q2", "rev", None, 9)]
    specs += [("n", None, "2025Q2", "rev", None, 1), ("n", None, "2025Q1", "rev", None, 2), ("x", "c", None, "rev", None, 3), ("x", "c", "soon", "rev", None, 4)]
    df = compare.period_deltas(figures(*specs), compare.quarter_ordinal(F.col("fiscal_period")))
    assert plan_of(df).count("Join") == 0
    number = {"2025Q1": 8100, "2025Q2": 8101}
    rows = [(d, c, number.get(p), m, s, v) for d, c, p, m, s, v in specs]
    later = {(c, p, d) for d, c, p, *_ in rows if c is not None and p is not None}
    base = [(c, m, s, p, d, bd, v) for bd, bc, bp, m, s, v in rows for c, p, d in later if bc == c and bp is not None and bp + 1 == p]
    want = []
    for d, c, p, m, s, v in rows:
        mine = [b for b in base if b[:5] == (c, m, s, p, d)]
        want += [(c, m, s, p, d, b[5], b[6], v) for b in mine] or [(c, m, s, p, d, None, None, v)]
    held = {(c, m, s, p, d) for d, c, p, m, s, _ in rows}
    want += [(*b[:6], b[6], None) for b in base if b[:5] not in held]
    got = df.select("company", "metric", "segment", "period_no", "document_id", "base_document_id", "base_value", "other_value").collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(key([*w[:6], *(None if v is None else D(v).quantize(D("1.0000")) for v in w[6:])]) for w in want)
    assert len(want) > 700


def test_questions_from_the_table_they_search(spark):
    """Blocks of questions and vectors that come from one table, as chunks that ask for their like."""
    rows = spark.range(400).selectExpr("id", "'d' as document_id", "'u' as user_id", "array(cos(id), sin(id)) as embedding")
    about = rows.selectExpr("id as qid", "user_id", "embedding", "array(document_id) as document_ids")
    best = search.batch_vector_search(about, rows, 1, payload=False, max_sent=0).collect()
    assert len(best) == 400 and all(r["qid"] == r["id"] and r["score"] == 1.0 for r in best)


def test_small_blocks_grow_with_the_table(spark, monkeypatch):
    """A row travels to a bounded number of blocks, not to one per hundred rows of the other side."""
    rows = spark.range(2_000).selectExpr("id", "'d' as document_id", "'u' as user_id", "array(cos(id), sin(id)) as embedding").cache()
    asked = rows.selectExpr("id as qid", "user_id", "embedding", "cast(null as array<string>) as document_ids")
    found = topk._block_join(asked, rows, ["user_id"], 3, 6, 10, 5)
    # At most k rows for each question and vector block; blocks of ten vectors would be 200.
    assert found.count() <= 2_000 * 3 * topk.MOST_BLOCKS
    got = topk.topk_join(asked, rows, ["user_id"], 3, max_sent=0, v_block=10, q_block=5).collect()
    want = topk.topk_join(asked, rows, ["user_id"], 3, max_sent=0).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 6_000


def test_many_questions_search_ranges_of_lists(spark, monkeypatch):
    rows = spark.range(1_500).selectExpr(
        "id", "concat('d', id % 5) as document_id", "concat('u', id % 2) as user_id", "if(id = 7, array(0D, 0D, 0D), array(cos(id), sin(id * 3), cos(id * 7))) as embedding"
    )
    asked = rows.selectExpr("id as qid", "user_id", "embedding", "if(id % 3 = 0, array('d1', 'd2'), null) as document_ids")
    index = search.build_ivf(rows, 12, max_iter=3)
    monkeypatch.setattr(search, "BROADCAST_ROWS", 100)
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 400)
    found = search.ann_search(asked, index, 4, n_probe=5)
    one_by_one = search.ann_search(asked, index, 4, n_probe=5, max_sent=0)
    assert sorted(map(str, found.collect())) == sorted(map(str, one_by_one.collect()))
    assert "lists" not in found.columns


def test_compressed_lists_are_met_in_ranges(spark, monkeypatch):
    """The same hits whether all lists are one range, each is its own, or blocks hold a part of a list."""
    rows = spark.range(900).selectExpr(
        "id", "concat('d', id % 5) as document_id", "concat('u', id % 2) as user_id", "array(cos(id), sin(id * 3), cos(id * 7), sin(id)) as embedding"
    )
    asked = rows.filter("id % 3 = 0").selectExpr("id as qid", "user_id", "embedding", "if(id % 2 = 0, array('d1', 'd2'), null) as document_ids")
    index = pq.build_pq(rows, n_lists=9)
    found, moved = [], []
    for block in (1_000_000, 300, 40):
        monkeypatch.setattr(pq, "CODE_BLOCK", block)
        hits = pq.pq_search(asked, index, rows, 4, n_probe=5)
        moved.append(plan_of(hits).count("FlatMapCoGroupsInArrow"))
        found.append(sorted(map(str, hits.collect())))
    assert found[0] == found[1] == found[2] and moved == [1, 1, 1] and len(found[0]) > 1_000


def test_points_look_into_their_own_keys_cells(spark):
    """A length that one key uses costs the points of other keys nothing."""
    points = spark.range(300).selectExpr("if(id % 3 = 0, 'a', if(id % 3 = 1, 'b', 'c')) as k", "id * 1000 as _at")
    lengths = [("a", 0, 1 << n) for n in range(4, 40, 4)] + [("b", 5_000, 90_000), (None, 0, 10), ("b", 9, 9)]
    intervals = spark.createDataFrame(lengths, "k string, _from bigint, _to bigint")
    met = temporal._meeting(points, intervals, ["k"], 100_000)
    assert met.filter("k = 'b'").select("_level").distinct().count() == 1 and met.filter("k = 'c'").count() == 0
    got = temporal.points_in_intervals(points, intervals, ["k"]).select("k", "_at", "_to").collect()
    want = [(p["k"], p["_at"], to) for p in points.collect() for k, f, to in lengths if k == p["k"] and f <= p["_at"] < to]
    assert sorted(map(tuple, got)) == sorted(want) and want
    assert "_levels" in plan_of(met) and temporal.points_in_intervals(points, intervals.limit(0), ["k"]).count() == 0
