"""Figures over periods, companies and segments."""

from __future__ import annotations

import json
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import compare
from ledgerloom.plans import compare_reports

METRICS = "document_id string, company string, fiscal_period string, metric string, value decimal(28,4), unit string, currency string"


def metrics(spark, *rows):
    return spark.createDataFrame([(*r[:4], None if r[4] is None else D(r[4]), *(r[5:] or ("units", "USD"))) for r in rows], METRICS)


def test_flatten_takes_the_latest(spark, at):
    figure = lambda v: {"value": v, "unit": "units", "currency": "USD", "source_page": 3}
    new = {"company": "Acme", "fiscal_period": "FY2025", "revenue": figure(123.5), "cash": figure(None), "segments": [{"name": "EU", **figure(7)}]}
    rows = [("a1", "metrics", ["d"], json.dumps({"revenue": figure(1)}), at(1)), ("a2", "metrics", ["d"], json.dumps(new), at(2)), ("a3", "insights", ["d"], "{}", at(3))]
    analyses = spark.createDataFrame(rows, "id string, type string, document_ids array<string>, result string, created_at timestamp")
    got = {(r["metric"], r["segment"], r["value"]) for r in compare.flatten_metrics(analyses).collect()}
    assert got == {("revenue", None, D("123.5000")), ("cash", None, None), ("segment_revenue", "EU", D("7.0000"))}


def test_units_and_currencies(spark):
    m = metrics(
        spark, ("d", "c", "FY1", "a", "2", "millions", "USD"), ("d", "c", "FY1", "b", "2", "thousands", "EUR"), ("d", "c", "FY2", "c", "2", "units", "EUR"),
        ("d", "c", "FY1", "e", "2", "dozens", "USD"), ("d", "c", "FY1", "f", None, "units", "EUR"),
    )
    rates = spark.createDataFrame([("EUR", "FY1", D("1.10000000"))], "currency string, fiscal_period string, rate decimal(18,8)")
    got = {r["metric"]: (r["value"], r["flag"]) for r in compare.normalize_units(m, rates).collect()}
    assert got == {
        "a": (D("2000000.0000"), None), "b": (D("2200.0000"), None), "c": (None, "missing_rate"), "e": (None, "unknown_unit"), "f": (None, None)
    }


def test_deltas(spark):
    m = metrics(
        spark, ("base", "c", "FY1", "up", "100"), ("o", "c", "FY2", "up", "150"), ("base", "c", "FY1", "turn", "-50"), ("o", "c", "FY2", "turn", "50"),
        ("base", "c", "FY1", "zero", "0"), ("o", "c", "FY2", "zero", "5"), ("base", "c", "FY1", "gone", "1"), ("o", "c", "FY2", "new", "1"),
        ("base", "c", "FY1", "mixed", "1", "units", "USD"), ("o", "c", "FY2", "mixed", "1", "millions", "USD"),
        ("base", "c", "FY1", "null", None), ("o", "c", "FY2", "null", None),
    )
    got = {r["metric"]: (r["delta"], r["growth"], r["flag"]) for r in compare.metric_deltas(m, "base", ["o"]).collect()}
    assert got == {
        "up": (D("50.0000"), 0.5, None), "turn": (D("100.0000"), 2.0, None), "zero": (D("5.0000"), None, None), "gone": (None, None, "missing_other"),
        "new": (None, None, "missing_base"), "mixed": (None, None, "unit_mismatch"), "null": (None, None, "missing_both"),
    }
    both = compare.metric_deltas(m, "base", ["o", "absent"])
    assert both.filter("document_id = 'absent' and flag = 'missing_other'").count() == 5


def test_growth_series_gives_null_at_gaps(spark):
    m = metrics(spark, *[(p, "c", p, "rev", v) for p, v in [("2024Q1", "100"), ("2024Q2", "110"), ("2024Q4", "120"), ("2025Q1", "90")]])
    by_quarter = {r["fiscal_period"]: (r["previous"], r["growth"]) for r in compare.growth_series(m).collect()}
    assert by_quarter["2024Q2"] == (D("100.0000"), 0.1) and by_quarter["2024Q4"] == (None, None) and by_quarter["2024Q1"] == (None, None)
    assert by_quarter["2025Q1"] == (D("120.0000"), -0.25)
    by_year = {r["fiscal_period"]: r["growth"] for r in compare.growth_series(m, 4).collect()}
    assert by_year["2025Q1"] == -0.1 and by_year["2024Q4"] is None


def test_matrix(spark):
    m = metrics(spark, ("d1", "a", "F", "rev", "5"), ("d2", "b", "F", "rev", "9"), ("d3", "c", "F", "rev", "9"), ("d1", "a", "F", "eps", None))
    docs = spark.createDataFrame([("d1", "u"), ("d2", "u"), ("d3", "v")], "id string, user_id string")
    rows = {r["metric"]: r for r in compare.compare_matrix(m, ["d1", "d2", "d3"]).collect()}
    assert (rows["rev"]["rank_d1"], rows["rev"]["rank_d2"], rows["rev"]["rank_d3"], rows["eps"]["rank_d1"]) == (2, 1, 1, None)
    own = {r["metric"]: r for r in compare.compare_matrix(m, ["d1", "d3"], docs, "u").collect()}
    assert own["rev"]["d3"] is None and own["rev"]["d1"] == D("5.0000")
    for bad in (["d1"], ["d1", "d1"], list("abcdef")):
        with pytest.raises(ValueError):
            compare.compare_matrix(m, bad)
    slots = spark.createDataFrame([("x", 1, "d1"), ("x", 2, "d2")], "comparison_id string, slot int, document_id string")
    many = {r["metric"]: r for r in compare.compare_many(m, slots).collect()}
    assert (many["rev"]["value_2"], many["rev"]["rank_1"], many["rev"]["rank_3"]) == (D("9.0000"), 2, None)


def test_margins_and_mix(spark):
    m = metrics(spark, ("d1", "c", "F", "revenue", "200"), ("d1", "c", "F", "gross_income", "50"), ("d2", "c", "G", "revenue", "0"), ("d2", "c", "G", "net_income", "5"))
    rows = {r["document_id"]: tuple(r)[3:] for r in compare.margins(m).collect()}
    assert rows == {"d1": (0.25, None, None), "d2": (None, None, None)}
    seg = spark.createDataFrame(
        [("c", "2024Q1", "EU", D(60)), ("c", "2024Q1", "US", D(40)), ("c", "2024Q2", "EU", D(50)), ("c", "2024Q2", "AS", D(50))],
        "company string, fiscal_period string, segment string, value decimal(28,4)",
    )
    total = spark.createDataFrame([("c", "2024Q1", D(110))], "company string, fiscal_period string, value decimal(28,4)")
    got = {(r["fiscal_period"], r["segment"]): (r["share"], r["share_change"], r["unexplained"]) for r in compare.segment_mix(seg, total).collect()}
    assert got[("2024Q1", "EU")] == (0.6, None, D("10.0000")) and got[("2024Q2", "AS")] == (0.5, None, None)
    assert got[("2024Q2", "EU")][1] == pytest.approx(-0.1)


def test_record(spark):
    deltas = spark.createDataFrame([("x", "d1", "rev", 5.0), ("x", "d2", "eps", None)], "comparison_id string, document_id string, metric string, delta double")
    evidence = spark.createDataFrame([("x", "d1", "c1", "risk"), ("y", "d3", "c2", "risk")], "comparison_id string, document_id string, chunk_id string, dimension string")
    rows = {r["comparison_id"]: r for r in compare.comparison_result(deltas, evidence).collect()}
    record = json.loads(rows["x"]["result"])
    assert record["document_ids"] == ["d1", "d2"] and [t["metric"] for t in record["table"]] == ["eps", "rev"]
    assert json.loads(rows["y"]["result"])["evidence"][0]["chunk_id"] == "c2"


def test_flow_compares_each_report_with_its_predecessor(spark, chunk):
    m = metrics(spark, ("d1", "c", "2024Q4", "revenue", "2", "thousands", "USD"), ("d2", "c", "2025Q1", "revenue", "3000", "units", "USD"))
    rates = spark.createDataFrame([], "currency string, fiscal_period string, rate decimal(18,8)")
    chunks = chunk(("k1", "d2", "u", [1.0, 0.0]), ("k2", "d2", "u", [0.0, 1.0]))
    rows = compare_reports(m, rates, chunks, {"risk": [1.0, 0.0]}, compare.quarter_ordinal(F.col("fiscal_period")), n=1)
    record = json.loads({r["comparison_id"]: r["result"] for r in rows.collect()}["d2"])
    assert record["table"][0]["delta"] == 1000.0 and record["table"][0]["growth"] == 0.5
    assert [e["chunk_id"] for e in record["evidence"]] == ["k1"]


def test_missing(spark):
    docs = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "id string")
    analyses = spark.createDataFrame([("metrics", ["d1", "d9"]), ("insights", ["d2"])], "type string, document_ids array<string>")
    assert sorted(r["id"] for r in compare.missing_metrics(docs, analyses).collect()) == ["d2", "d3"]


def test_ordinals(spark):
    df = spark.createDataFrame([("2025Q3",), ("FY2025Q4",), ("FY2025",), ("n/a",)], "p string")
    got = [tuple(r) for r in df.select(compare.quarter_ordinal(F.col("p")), compare.year_ordinal(F.col("p"))).collect()]
    assert got == [(8102, None), (8103, None), (None, 2025), (None, None)]


def test_broken_analyses_hide_nothing(spark, at):
    figure = {"value": 5, "unit": "units", "currency": "USD", "source_page": 2}
    prior = {"fiscal_period": "FY2024", "revenue": {**figure, "value": 4}, "cash": {**figure, "value": 1}}
    good = json.dumps({"company": "Acme", "fiscal_period": "FY2025", "revenue": figure, "prior": prior, "guidance": [{"text": "up", "source_page": 3}, {"text": "more", "source_page": None}]})
    rows = [
        ("a1", "metrics", ["d1", "d2"], good, at(1)), ("a2", "metrics", ["d1"], good[:30], at(2)), ("a3", "metrics", ["d3"], "{", at(1)),
        ("a4", "metrics", ["d4"], None, at(1)), ("a5", "insights", ["d5"], good, at(1)),
    ]
    analyses = spark.createDataFrame(rows, "id string, type string, document_ids array<string>, result string, created_at timestamp")
    figures = compare.flatten_metrics(analyses)
    assert sorted((r["document_id"], r["metric"], r["value"]) for r in figures.collect()) == [("d1", "revenue", D("5.0000")), ("d2", "revenue", D("5.0000"))]
    docs = spark.createDataFrame([(f"d{i}",) for i in range(1, 7)], "id string")
    missing = {r["id"] for r in compare.missing_metrics(docs, analyses).collect()}
    assert missing == {"d3", "d4", "d5", "d6"} == {r["id"] for r in docs.collect()} - {r["document_id"] for r in figures.collect()}
    words = [tuple(r) for r in compare.flatten_guidance(analyses).filter("document_id = 'd1'").orderBy("position").collect()]
    assert words == [("d1", "Acme", "FY2025", 1, "up", 3), ("d1", "Acme", "FY2025", 2, "more", None)]
    said = compare.flatten_comparatives(analyses).filter("document_id = 'd2'")
    assert {(r["fiscal_period"], r["metric"], r["value"]) for r in said.collect()} == {("FY2024", "revenue", D("4.0000")), ("FY2024", "cash", D("1.0000"))}
    own = metrics(spark, ("old", "Acme", "FY2024", "revenue", "5"), ("other", "Beta", "FY2024", "cash", "1"))
    got = {r["metric"]: (r["base_document_id"], r["flag"], r["delta"], r["growth"]) for r in compare.restatements(own, said).collect()}
    assert got == {"revenue": ("old", "restated", D("-1.0000"), -0.2), "cash": (None, "not_reported", None, None)}


def test_a_comparison_names_its_base(spark):
    m = metrics(spark, ("base", "c", "2024Q1", "up", "1"), ("o", "c", "2024Q2", "up", "2"))
    deltas = compare.period_deltas(m, compare.quarter_ordinal(F.col("fiscal_period"))).withColumn("comparison_id", F.col("document_id"))
    none = spark.createDataFrame([], "comparison_id string, document_id string, chunk_id string")
    got = {r["comparison_id"]: r["document_ids"] for r in compare.comparison_result(deltas, none).collect()}
    assert got == {"o": ["base", "o"], "base": ["base"]}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_companies_in_one_place_do_not_travel(spark):
    """F3, F8: with ``together`` the deltas are the same and only the given grouping shuffles; records are put together once."""
    schema = "document_id string, company string, fiscal_period string, metric string, value decimal(28,4), unit string, currency string"
    rows = [(f"{c}-{q}", c, f"2024Q{q}", m, None if (q, m) == (2, "revenue") else D(i), "units", "USD") for i, (c, q, m) in enumerate(
        (c, q, m) for c in ("a", "b", None) for q in (1, 2, 4) for m in ("revenue", "taxes"))]
    metrics = spark.createDataFrame(rows, schema)
    ordinal = compare.quarter_ordinal(F.col("fiscal_period"))
    placed = compare.period_deltas(metrics.repartition("company"), ordinal, together=True)
    # One for the given grouping in either branch: rows that are compared, and rows without a company or period.
    assert _plan(placed).count("Exchange hashpartitioning") <= 2
    assert sorted(map(str, placed.collect())) == sorted(map(str, compare.period_deltas(metrics, ordinal).collect()))
    import __spark_entry__ as driver

    found = _plan(driver.queries()["f9_comparison_result"](spark, "/root/testdata/sf0.001"))
    assert found.count("FullOuter") == 1


def test_few_rates_are_sent_to_the_figures(spark):
    """F8: figures are not gathered by currency and period; a figure keeps a row per rate as before."""
    figures = metrics(spark, *[(f"d{i}", "Acme", "2024Q1", "revenue", i, "units", "EUR") for i in range(4)])
    rates = spark.createDataFrame([("EUR", "2024Q1", D(2))], "currency string, fiscal_period string, rate decimal(18,8)")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        priced = compare.normalize_units(figures, rates)
        assert "Exchange hashpartitioning" not in _plan(priced)
        assert sorted(int(r["value"]) for r in priced.collect()) == [0, 2, 4, 6]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_comparisons_are_gathered_without_sorting(spark):
    """slots are gathered in place."""
    metrics = spark.createDataFrame([("d1", "revenue", D(1)), ("d2", "revenue", D(2))], "document_id string, metric string, value decimal(28,4)")
    slots = spark.createDataFrame([("c", 1, "d1"), ("c", 2, "d2")], "comparison_id string, slot int, document_id string")
    wide = compare.compare_many(metrics, slots)
    assert "SortAggregate" not in _plan(wide)
    row = wide.first()
    assert (row["value_1"], row["value_2"], row["rank_1"], row["rank_2"]) == (1, 2, 2, 1)
