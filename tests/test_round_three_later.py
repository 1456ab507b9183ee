"""Queries that outgrew their limits: the same rows from fewer files, less moved and less parsed."""

from __future__ import annotations

import datetime as dt
import os
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from checks.inputs import SCHEMAS, Inputs
from checks.comparisons import later_analyses
from checks.texts import c3_tables, c4
from ledgerloom.operators import compare
from ledgerloom.operators.text import tables_to_markdown
from ledgerloom.session import shared_dir
from ledgerloom.sources import objects


@pytest.mark.parametrize("mounted", [True, False])
def test_objects_are_stored_without_a_folder_each(spark, tmp_path, monkeypatch, mounted):
    """Every row is an object, also those that come twice or lack something; folders do not grow with them."""
    if not mounted:
        monkeypatch.setattr(objects, "mounted_path", lambda *_: None)
    rows = [(f"s{i % 2}", i, f"text {i}") for i in range(60)] + [(None, 60, None), ("a/b", None, "x\ny"), ("", 61, "")]
    rows += [("s1", 1, "text 1")]
    root = f"file://{tmp_path}/kept"
    objects.store_objects(spark.createDataFrame(rows, "user string, document long, text string").repartition(3), root)
    names = [F.regexp_extract("path", objects.STORED_PATTERN, n).alias(c) for n, c in ((1, "user"), (2, "document"))]
    found = objects.scan_objects(spark, root, "*.txt", with_content=True).select(*names, "size", "content").collect()
    got = [(r["user"], r["document"], bytes(r["content"])) for r in found]
    want = {(u if u else objects.NO_NAME, objects.NO_NAME if d is None else str(d), ((x or "") + "\n").encode()) for u, d, x in rows}
    assert {(u.replace("%2F", "/"), d, c) for u, d, c in got} == want
    if mounted:
        assert len(got) == len(rows) and all(r["size"] == len(r["content"]) for r in found)
        folders = [f for f, inner, _ in os.walk(tmp_path) if not inner]
        assert len(folders) <= 3 * 5
        assert not [f for f in os.listdir(tmp_path / "kept") if f.startswith("_")]


def test_where_objects_are_stored(spark):
    assert objects.mounted_path(spark, "file:///a/b:c") == objects.mounted_path(spark, "/a/b:c") == "/a/b:c"
    assert objects.mounted_path(spark, "s3a://bucket/a") is None
    root = shared_dir(spark, "none")
    objects.store_objects(spark.createDataFrame([], "user string, document long, text string"), root)
    assert objects.scan_objects(spark, root, "*.txt").count() == 0


def test_whole_rows_make_the_tables_of_their_cells(spark):
    """Rows of other columns, repeated and empty cells, pipes, blanks and backslashes beside separators."""
    deal = random.Random(5)
    values = ["", "a", " | ", "|", "\\", "\\|", " ", "x\ny", None, "| b |"]
    rows = [("d", 1, t, r, [(c, deal.choice(values)) for c in deal.choices(range(4), k=deal.randint(1, 5))]) for t in range(3) for r in range(40)]
    rows += [("d", 1, 9, r, [(c, str(r)) for c in (1, 2, 3)]) for r in range(5)]
    names = "document_id string, page_no int, table_no int, row_no int"
    whole = tables_to_markdown(spark.createDataFrame(rows, f"{names}, cells array<struct<col_no: int, value: string>>"))
    cells = tables_to_markdown(spark.createDataFrame([(*r[:4], *c) for r in rows for c in r[4]], f"{names}, col_no int, value string"))
    got = {r["table_no"]: r["markdown"] for r in whole.collect()}
    assert got == {r["table_no"]: r["markdown"] for r in cells.collect()}

    def text(v):
        return " ".join((v or "").replace("|", "\\|").splitlines())

    for t, markdown in got.items():
        mine = [r[4] for r in rows if r[2] == t]
        columns = sorted({c for r in mine for c, _ in r})
        want = [f"| {' | '.join(' '.join(sorted(text(v) for c, v in r if c == n)) for n in columns)} |" for r in mine]
        want.insert(1, f"| {' | '.join('---' for _ in columns)} |")
        assert markdown == "\n".join(want)


@pytest.mark.parametrize(("query", "exchanges"), [(c3_tables, 3), (c4, 1)])
def test_rows_of_tables_travel_once(spark, tmp_path, query, exchanges):
    """Order lines once; then tables and documents by document."""
    rows = {"lineitem": [(i, 1, i % 3, i % 4, 1.0, 2.0, 0.0, 0.0, "R", "F", None) for i in range(20)], "documents": [(1, "a\nb c", "en", "s", 5)]}
    for name, some in rows.items():
        spark.createDataFrame(some, SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    df = query(Inputs(spark, str(tmp_path)))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= exchanges
    assert df.count()


def test_restatements_meet_the_lists_of_a_period(spark):
    """Two reports of a period, repeated metrics, segments, and nulls in what names a figure."""
    cols = "document_id string, company string, fiscal_period string, metric string, segment string, value decimal(28,4)"
    own = [("b1", "c", "P", "rev", None, D(1)), ("b2", "c", "P", "rev", None, D(2)), ("b1", "c", "P", "rev", None, D(1)), ("b1", "c", "P", "cash", None, None)]
    own += [("b1", "c", "P", "eps", "s", D(9)), ("n", None, "P", "rev", None, D(3)), ("n", "c", None, "rev", None, D(3)), ("n", "c", "P", None, None, D(3))]
    said = [("o", c, p, m, None, D(2)) for c, p, m in [("c", "P", "rev"), ("c", "P", "cash"), ("c", "P", "eps"), (None, "P", "rev"), ("c", None, "rev"), ("c", "P", None), ("d", "P", "rev")]]
    df = compare.restatements(*(spark.createDataFrame(rows, cols) for rows in (own, said)))
    assert df.columns == ["company", "fiscal_period", "metric", "document_id", "other_value", "base_document_id", "base_value", "flag", "delta", "growth"]
    got = sorted(((r["company"], r["fiscal_period"], r["metric"], r["base_document_id"], r["base_value"], r["flag"]) for r in df.collect()), key=str)
    none = (None, None, "not_reported")
    want = [("c", "P", "rev", "b1", D(1), "restated")] * 2 + [("c", "P", "rev", "b2", D(2), None), ("c", "P", "cash", "b1", None, "not_reported")]
    want += [("c", "P", "eps", *none), (None, "P", "rev", *none), ("c", None, "rev", *none), ("c", "P", None, *none), ("d", "P", "rev", *none)]
    assert got == sorted(want, key=str)


def test_own_figures_stay_by_period(spark):
    """Figures that lie by company and period do not travel to be compared."""
    figures = spark.range(100).selectExpr("string(id % 7) as company", "string(id) as fiscal_period", "'rev' as metric", "string(id) as document_id", "id as value")
    df = compare.restatements(figures.repartition("company", "fiscal_period").hint("merge"), figures)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2


def test_the_quarter_before_is_found_in_place(spark, tmp_path):
    quarters = [(2020, 1), (2020, 4), (2020, 10), (2021, 1), (2021, 7)]
    rows = [(n, part, 1, n, 1.0, 100.0 * n, 0.0, 0.0, "R", "F", dt.datetime(y, m, 2)) for part in (1, 2, None) for n, (y, m) in enumerate(quarters, 1)]
    rows.append((9, 1, 1, 9, 1.0, 900.0, 0.0, 0.0, "R", "F", None))
    spark.createDataFrame(rows, SCHEMAS["lineitem"]).write.parquet(f"{tmp_path}/lineitem.parquet")
    stored = later_analyses(Inputs(spark, str(tmp_path)))
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 1
    got = {(r["document_id"], r["fiscal_period"], r["value"]) for r in compare.flatten_comparatives(stored).collect()}
    assert got == {(f"p{p}-{now}", before, D(value)) for p in (1, 2) for now, before, value in [("2020Q2", "2020Q1", 101), ("2021Q1", "2020Q4", 301)]}


def test_unclosed_texts_are_no_analyses(spark):
    texts = ["{", " {\"a\": 1", "{\"a\": {}", "{}", " {} x", "[1]", "[1", "5", "{\"a\": \"}\"", None, "x }", "{\"a\": [1}"]
    rows = [(str(i), "metrics", [str(i)], x, None) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, type string, document_ids array<string>, result string, created_at timestamp")
    got = {r["id"] for r in compare._readable(df).collect()}
    assert got == {r["id"] for r in df.filter(F.try_parse_json("result").isNotNull()).collect()}
