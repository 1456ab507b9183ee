"""Chunks of reports with tables: whole rows, repeated headers, every cell once outside overlaps."""

from __future__ import annotations

import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom import streaming
from ledgerloom.operators.layout import chunk_with_tables, windows
from ledgerloom.operators.text import chunk_documents, tables_to_markdown
from ledgerloom.plans import ingest_documents

HEADINGS = {"One": r"^# One", "Two": r"^# Two"}
CELLS = "document_id string, page_no int, after_line int, table_no int, row_no int, col_no int, value string"


@st.composite
def layouts(draw):
    sizes, headers = [], []
    for _ in range(draw(st.integers(0, 6))):
        if draw(st.booleans()):
            words = draw(st.integers(1, 30))
            sizes += [1] * words
            headers += [0] * words
        else:
            head = draw(st.integers(2, 8))
            rows = draw(st.lists(st.integers(1, 25), max_size=8))
            sizes += [head, *rows]
            headers += [0, *[head] * len(rows)]
    return sizes, headers


def plain_windows(sizes, headers, target, overlap):
    """The rule of ``windows``, tried out unit by unit."""
    n, first = len(sizes), 0
    while first < n:
        stop = first + 1
        while stop < n and headers[first] + sum(sizes[first : stop + 1]) <= target:
            stop += 1
        yield first, stop
        if stop == n:
            return
        first = next(
            (c for c in range(first + 1, stop) if sum(sizes[c:stop]) <= overlap and headers[c] + sum(sizes[c : stop + 1]) <= target), stop
        )


@given(layouts(), st.integers(1, 40), st.integers(0, 39))
def test_windows(layout, target, overlap):
    sizes, headers = layout
    if overlap >= target:
        return
    got = list(windows(sizes, headers, target, overlap))
    assert got == list(plain_windows(sizes, headers, target, overlap))
    assert not sizes or (got[0][0] == 0 and got[-1][1] == len(sizes))
    for (a, b), (c, d) in zip(got, got[1:]):
        assert a < c <= b < d and sum(sizes[c:b]) <= overlap
    assert all(b == a + 1 or headers[a] + sum(sizes[a:b]) <= target for a, b in got)


def grid(doc, page, after, table, rows, columns=3):
    out = [(doc, page, after, table, 0, c, f"head{c}") for c in range(columns)]
    return out + [(doc, page, after, table, r, c, f"v{table}_{r}_{c}") for r in range(1, rows + 1) for c in range(columns)]


def test_tables_stand_in_their_places(spark):
    text = "\n".join(["before it", "# One", "alpha beta", "# Two", *[f"line{i} gamma" for i in range(50)]])
    docs = spark.createDataFrame([("a", text, "u"), ("b", "plain words only", "u"), ("c", None, "u"), ("d", None, "u"), ("e", "", "u")], "id string, text string, owner string")
    cells = grid("a", 1, 3, 1, 40) + grid("a", 2, None, 2, 2) + grid("c", 4, None, 1, 3) + grid("z", 1, None, 1, 2)
    tables = tables_to_markdown(spark.createDataFrame(cells, CELLS).repartition(5))
    rows = chunk_with_tables(docs, tables, HEADINGS, target=60, overlap=12, keep=("owner",)).orderBy("document_id", "chunk_index").collect()
    assert {r["document_id"] for r in rows} == {"a", "b", "c"}
    by_doc = {d: [r for r in rows if r["document_id"] == d] for d in "abc"}
    assert [r["chunk_index"] for r in by_doc["a"]] == list(range(len(by_doc["a"])))
    assert len({r["id"] for r in rows}) == len(rows) and {r["owner"] for r in rows} == {"u"}
    assert [r["text"] for r in by_doc["b"]] == ["plain words only"]
    assert by_doc["c"][0]["page_start"] == 4 and by_doc["c"][0]["section"] is None
    holding = [r for r in by_doc["a"] if "v1_" in r["text"]]
    assert {r["section"] for r in holding} == {"One"} and {r["page_start"] for r in holding} == {1}
    assert by_doc["a"][0]["text"] == "before it" and by_doc["a"][0]["section"] is None
    for r in rows:
        assert r["token_count"] == len(r["text"].split()) <= 60
        lines = r["text"].split("\n")
        for i, line in enumerate(lines):
            if line.startswith("| v"):
                assert re.fullmatch(r"\| (v\d+_\d+_)0 \| \1(1) \| \1(2) \|", line)
                assert any(x == "| head0 | head1 | head2 |" for x in lines[:i])
    # In order, and outside overlaps once: rows met first in a chunk make up the table.
    met = [int(n) for r in holding for n in re.findall(r"v1_(\d+)_0", r["text"])]
    assert list(dict.fromkeys(met)) == list(range(1, 41)) and max(met.count(n) for n in met) <= 2
    assert "v2_1_0" in "".join(r["text"] for r in by_doc["a"] if r["section"] == "Two" and r["page_end"] == 2)


def test_without_tables_like_plain_chunks(spark):
    text = "\n".join(f"# One {i}" if i % 37 == 5 else f"w{i} x y" for i in range(300))
    docs = spark.createDataFrame([("a", text), ("b", "no heading\n" * 500), ("c", "\n\n"), ("d", "p1 x\fp2 y\n# Two\fp3")], "id string, text string")
    none = spark.createDataFrame([], "document_id string, page_no int, table_no int, markdown string")
    for how in ({}, {"page_sep": "\f"}, {"lines_per_page": 7}):
        same = [f(docs, *t, HEADINGS, target=50, overlap=10, **how) for f, t in ((chunk_documents, ()), (chunk_with_tables, (none,)))]
        plain, with_tables = (sorted(map(tuple, df.select("id", "section", "page_start", "page_end", "text", "token_count", "chunk_index").collect())) for df in same)
        assert plain == with_tables


def test_long_rows_are_chunks_of_their_own(spark):
    cells = [("a", 1, None, 1, r, 0, "word " * (1 if r != 2 else 30)) for r in range(4)]
    tables = tables_to_markdown(spark.createDataFrame(cells, CELLS))
    docs = spark.createDataFrame([("a", "x y")], "id string, text string")
    rows = chunk_with_tables(docs, tables, HEADINGS, target=20, overlap=5).orderBy("chunk_index").collect()
    assert [r["text"].count("word") for r in rows] == [2, 31, 2]
    assert all("| --- |" in r["text"] for r in rows)


def test_markdown_places(spark):
    cells = [("a", 1, None, 1, 0, 5, "h|5"), ("a", 1, None, 1, 0, 2, "h\n2"), ("a", 1, 9, 1, 1, 5, None), ("a", 1, 4, 1, 2, 7, "z"), ("a", 1, 4, 1, 2, 7, "b"), ("a", 1, None, 1, 2, 2, "")]
    got = tables_to_markdown(spark.createDataFrame(cells, CELLS)).first()
    assert got["markdown"] == "| h 2 | h\\|5 |  |\n| --- | --- | --- |\n|  |  |  |\n|  |  | b z |" and got["after_line"] == 4
    plain = tables_to_markdown(spark.createDataFrame(cells, CELLS).drop("after_line"))
    assert plain.columns == ["document_id", "page_no", "table_no", "markdown"] and plain.count() == 1
    exchanges = plain._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges == 1


def test_flow_and_stream_take_cells(spark, tmp_path):
    facts = "id string, user_id string, company string, fiscal_period string, report_type string, text string"
    docs = spark.createDataFrame([("a", "u", "c", "FY2025", "10-K", "some words"), ("b", "u", "c", "FY2025", "10-K", "other words")], facts)
    cells = spark.createDataFrame(grid("a", 1, None, 1, 3), CELLS)
    batch = ingest_documents(docs, cells=cells)
    assert sorted(r["document_id"] for r in batch.collect()) == ["a", "b"]
    assert "| v1_3_0 | v1_3_1 | v1_3_2 |" in batch.filter("document_id = 'a'").first()["text"]
    docs.write.parquet(str(tmp_path / "in"))
    streaming.stream_ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), facts, cells=lambda d: cells.join(d.select(F.col("id").alias("document_id")), "document_id")).awaitTermination()
    index = streaming.read_stream_index(spark, str(tmp_path / "out"))
    assert {(r["id"], r["text"]) for r in index.collect()} == {(r["id"], r["text"]) for r in batch.collect()}


def test_bad_sizes(spark):
    with pytest.raises(ValueError, match="overlap"):
        chunk_with_tables(spark.range(0), spark.range(0), target=5, overlap=5)
