"""From report text to pages, sections and chunks, and from detected facts to metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import bind, content_ref_of, words
from ledgerloom.functions.core import as_column
from ledgerloom.operators.maintenance import latest
from ledgerloom.operators.rows import keep_first

# The report parts that sections are named after, and the chunk sizes.
REPORT_HEADINGS = {
    "MD&A": r"(?i)^\s*(item\s+7\.?\s*)?management.s discussion and analysis",
    "Risk Factors": r"(?i)^\s*(item\s+1a\.?\s*)?risk factors\s*$",
    "Financial Statements": r"(?i)^\s*(item\s+8\.?\s*)?(consolidated\s+)?financial statements",
    "Notes": r"(?i)^\s*notes to (the\s+)?(consolidated\s+)?financial statements",
}
TARGET_TOKENS = 800
OVERLAP_TOKENS = 100
PAGES_PER_GROUP = 5


def _lines_of(text: Column, lines_per_page: int | None, page_sep: str | None) -> Column:
    """Array of (page_no, line) in reading order."""
    if page_sep is not None:
        pages = F.split(text, r"\Q" + page_sep + r"\E")
        return F.flatten(
            F.transform(
                pages,
                lambda p, i: F.transform(
                    F.split(p, "\n"), lambda line: F.struct((i + 1).cast("int").alias("page_no"), line.alias("line"))
                ),
            )
        )
    per_page = lines_per_page or 40
    return F.transform(
        F.split(text, "\n"),
        lambda line, i: F.struct((F.floor(i / per_page) + 1).cast("int").alias("page_no"), line.alias("line")),
    )


def split_pages(
    docs: DataFrame,
    lines_per_page: int | None = 40,
    page_sep: str | None = None,
    id_col: str = "id",
    text_col: str = "text",
) -> DataFrame:
    """One row per line: document_id, page_no, line_no (both from 1), line. No shuffle."""
    lines = _lines_of(F.col(text_col), lines_per_page, page_sep)
    return docs.select(F.col(id_col).alias("document_id"), F.posexplode(lines).alias("_pos", "_line")).select(
        "document_id", "_line.page_no", (F.col("_pos") + 1).alias("line_no"), "_line.line"
    )


def _heading(line: Column, headings: Mapping[str, str]) -> Column:
    """Name of the section a line opens, null for an ordinary line. Earlier entries win."""
    return F.coalesce(*[F.when(line.rlike(p), F.lit(n)) for n, p in headings.items()], F.lit(None).cast("string"))


def _page_group(page: Column) -> Column:
    return F.floor((page - 1) / PAGES_PER_GROUP).cast("int")


def detect_sections(lines: DataFrame, headings: Mapping[str, str] = REPORT_HEADINGS) -> DataFrame:
    """Add ``section`` (null before the first heading) and its ordinal ``section_no`` to every line.

    A heading line belongs to the section it opens. A document without any heading is cut into
    groups of pages instead. One shuffle by document; a document's size is bounded by the library.
    """
    doc = "partition by document_id"
    upto = f"{doc} order by line_no rows between unbounded preceding and current row"
    marked = lines.withColumn("_heading", _heading(F.col("line"), headings)).withColumns(
        {
            "section": F.expr(f"last(_heading, true) over ({upto})"),
            "_opened": F.expr(f"count(_heading) over ({upto})").cast("int"),
            "_any": F.expr(f"count(_heading) over ({doc})"),
        }
    )
    section_no = F.when(F.col("_any") > 0, F.col("_opened")).otherwise(_page_group(F.col("page_no")))
    return marked.withColumn("section_no", section_no).select(*lines.columns, "section", "section_no")


def _cut(lines: Column, starts: Column, target: int, overlap: int) -> Column:
    """Array of chunks from a document's lines and the positions where its sections start.

    ``lines`` is array<struct<section, page_no, line>>. Every token keeps its page.
    """
    if not 0 <= overlap < target:
        raise ValueError("need 0 <= overlap < target")

    step = target - overlap

    def windows(section: Column, tokens: Column, pages: Column) -> Column:
        """``pages`` names the page of every token; it never falls, so a window's ends tell its range."""
        last = F.greatest(F.lit(0), F.size(tokens) - overlap - 1)
        begin = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), last, F.lit(step)))

        def chunk(s: Column) -> Column:
            stop = F.least(s + target, F.size(tokens))
            return F.struct(
                section.alias("section"),
                F.get(pages, s).alias("page_start"),
                F.get(pages, stop - 1).alias("page_end"),
                F.array_join(F.slice(tokens, s + 1, F.lit(target)), " ").alias("text"),
                (stop - s).alias("token_count"),
            )

        return F.coalesce(F.transform(begin, chunk), F.array())

    def section_chunks(start: Column, j: Column, all_lines: Column, all_starts: Column) -> Column:
        stop = F.coalesce(F.get(all_starts, j + 1), F.size(all_lines))
        body = F.slice(all_lines, start + 1, stop - start)
        split = F.transform(body, lambda ln: F.struct(words(ln["line"]).alias("words"), ln["page_no"].alias("page_no")))

        def with_pages(by_line: Column) -> Column:
            tokens = F.flatten(F.transform(by_line, lambda b: b["words"]))
            pages = F.flatten(F.transform(by_line, lambda b: F.array_repeat(b["page_no"], F.size(b["words"]))))
            section = F.get(all_lines, start)["section"]
            return bind(F.struct(tokens.alias("t"), pages.alias("p")), lambda tp: windows(section, tp["t"], tp["p"]))

        return bind(split, with_pages)

    return bind(
        lines,
        lambda ls: bind(starts, lambda ss: F.flatten(F.transform(ss, lambda s, j: section_chunks(s, j, ls, ss)))),
    )


def chunk_id() -> Column:
    """A chunk's id, derived from its document and its place in it."""
    return F.sha2(F.concat_ws("|", F.col("document_id").cast("string"), F.col("chunk_index").cast("string")), 256)


def _as_rows(docs: DataFrame, chunks: Column, keep: Sequence[str] = ()) -> DataFrame:
    rows = docs.select("document_id", *keep, F.posexplode(chunks).alias("chunk_index", "_chunk"))
    return rows.select(chunk_id().alias("id"), "document_id", *keep, "_chunk.*", "chunk_index")


def chunk_windows(lines: DataFrame, target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Token windows per section run, from lines as :func:`detect_sections` gives them.

    Windows hold ``target`` tokens and step by ``target - overlap``; they never cross a section and
    never consist of overlap alone. ``chunk_index`` counts from 0 per document, ``id`` is derived
    from document and index. Input already partitioned by document is not shuffled again.
    """
    entry = F.struct("section_no", "line_no", "section", "page_no", "line")
    docs = lines.groupBy("document_id").agg(F.array_sort(F.collect_list(entry)).alias("_lines"))
    at = F.col("_lines")
    starts = F.filter(
        F.sequence(F.lit(0), F.size(at) - 1),
        lambda i: (i == 0) | (F.get(at, i)["section_no"] != F.get(at, i - 1)["section_no"]),
    )
    return _as_rows(docs, _cut(at, starts, target, overlap))


def chunk_documents(
    docs: DataFrame,
    headings: Mapping[str, str] = REPORT_HEADINGS,
    target: int = TARGET_TOKENS,
    overlap: int = OVERLAP_TOKENS,
    lines_per_page: int | None = 40,
    page_sep: str | None = None,
    id_col: str = "id",
    text_col: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Pages, sections and chunks of whole documents in one narrow step, without any shuffle.

    Gives the same rows as ``chunk_windows(detect_sections(split_pages(docs)))``. Columns in ``keep``
    are carried from the document to its chunks.
    """
    raw = _lines_of(F.col(text_col), lines_per_page, page_sep)
    named = F.transform(
        raw,
        lambda ln: F.struct(_heading(ln["line"], headings).alias("section"), ln["page_no"].alias("page_no"), ln["line"].alias("line")),
    )
    staged = docs.select(F.col(id_col).alias("document_id"), *keep, named.alias("_lines")).filter("_lines is not null")
    at = F.col("_lines")
    has_heading = F.exists(at, lambda ln: ln["section"].isNotNull())
    starts = bind(
        has_heading,
        lambda any_heading: F.filter(
            F.sequence(F.lit(0), F.size(at) - 1),
            lambda i: (i == 0)
            | F.when(any_heading, F.get(at, i)["section"].isNotNull()).otherwise(
                _page_group(F.get(at, i)["page_no"]) != _page_group(F.get(at, i - 1)["page_no"])
            ),
        ),
    )
    return _as_rows(staged, _cut(at, starts, target, overlap), keep)


# Between the cells of a table's row.
SEPARATOR = " | "


def tables_to_markdown(cells: DataFrame, together: bool = False) -> DataFrame:
    """Cells (document_id, page_no, table_no, row_no, col_no, value) to one Markdown text per table.

    The first row is the header. Every row has a place for each ``col_no`` of the table, so an absent cell
    is empty and moves no other. Pipes are escaped, line breaks become blanks, null gives an empty cell;
    values of cells with the same place stand side by side. Whole rows may be given instead, with an array ``cells`` of
    (col_no, value) and each ``row_no`` of a table once; they are not taken apart and put together again. A column ``after_line`` (where in
    the document the table stands) is kept, its least value counts. One shuffle, by table, or none where rows
    lie by table or document already (``together``); a table's cells are held by one task.
    """
    table = ["document_id", "page_no", "table_no"]
    place = ["after_line"] if "after_line" in cells.columns else []

    def cell(of: Column) -> Column:
        value = F.replace(F.coalesce(of["value"], F.lit("")), F.lit("|"), F.lit("\\|"))
        return F.struct(of["col_no"].alias("col_no"), F.regexp_replace(value, r"[\r\n]+", " ").alias("value"))

    rowwise = "cells" in cells.columns
    given = F.transform("cells", cell) if rowwise else cell(F.struct("col_no", "value"))
    rows = cells.select(*table, *place, "row_no", given.alias("_cells"))
    # All groupings are by the table and more, so the one shuffle by table serves them all.
    if not together:
        rows = rows.repartition(*table)
    if not rowwise:
        rows = rows.groupBy(*table, "row_no").agg(F.collect_list("_cells").alias("_cells"), *[F.min(c).alias(c) for c in place])
    # A row travels as one text; as pipes are escaped, it can be told apart again where its table has more columns than it.
    rows = rows.withColumn("_cells", F.array_sort("_cells"))
    row = F.struct("row_no", F.col("_cells.col_no").alias("columns"), F.array_join(F.col("_cells.value"), SEPARATOR).alias("text"))
    whole = rows.groupBy(*table).agg(
        F.array_sort(F.collect_list(row)).alias("_rows"),
        # Rows of a table mostly agree in their columns.
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.col("_cells.col_no"))))).alias("_columns"),
        *[F.min(c).alias(c) for c in place],
    )

    def text_row(values: Column) -> Column:
        return F.concat(F.lit("| "), values, F.lit(" |"))

    def row_text(r: Column) -> Column:
        def at(n: Column) -> Column:
            return F.array_join(F.filter(F.split(r["text"], r" \| "), lambda _, i: F.get(r["columns"], i) == n), " ")

        spread = F.array_join(F.transform("_columns", at), SEPARATOR)
        return text_row(F.when(r["columns"] == F.col("_columns"), r["text"]).otherwise(spread))

    rule = text_row(F.array_join(F.transform("_columns", lambda _: F.lit("---")), SEPARATOR))
    lines = F.transform("_rows", lambda r, i: F.when(i == 0, F.concat(row_text(r), F.lit("\n"), rule)).otherwise(row_text(r)))
    return whole.select(*table, *place, F.array_join(lines, "\n").alias("markdown"))


def enrich_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Give every chunk its document's owner, company, period and report type."""
    facts = documents.select(
        F.col("id").alias("document_id"), "user_id", "company", "fiscal_period", "report_type"
    )
    return chunks.join(facts, "document_id")


# Rules for reports in English: (pattern, value); the value is group 1 when None.
METADATA_RULES: dict[str, Sequence[tuple[str, str | None]]] = {
    "report_type": (
        (r"(?i)\bform\s+10-K\b", "10-K"),
        (r"(?i)\bform\s+10-Q\b", "10-Q"),
        (r"(?i)\bannual report\b", "annual"),
        (r"(?i)\bearnings release\b", "earnings"),
    ),
    "fiscal_period": ((r"(?i)\bfiscal year (?:ended .*)?(20\d\d|19\d\d)\b", None), (r"\b(FY\d{4})\b", None)),
    "currency": ((r"(?i)\bin (?:millions|thousands) of (?:U\.?S\.?) dollars\b", "USD"), (r"\b(USD|EUR|GBP|JPY|CHF)\b", None)),
    "ticker": ((r"\b(?:NYSE|NASDAQ|Nasdaq)\s*:\s*([A-Z.]{1,6})\b", None),),
    "company": ((r"^\s*(.+?(?:Inc\.|Corp\.|Corporation|Ltd\.|PLC|AG|SE))\s*$", None),),
    "fiscal_year_end": ((r"(?i)\bfiscal year ended ([A-Z][a-z]+ \d{1,2})\b", None),),
}


def detect_metadata(
    lines: DataFrame,
    rules: Mapping[str, Sequence[tuple[str, str | None]]] = METADATA_RULES,
    max_pages: int = 10,
) -> DataFrame:
    """One row per document with the first match of every field on its first pages, else null.

    First means by page, line and rule order. The scan is reduced per task before its one shuffle.
    """

    def found(field: str) -> Column:
        line = F.col("line")
        hits = []
        for pattern, value in rules[field]:
            got = F.lit(value) if value is not None else F.regexp_extract(line, pattern, 1)
            hits.append(F.when(line.rlike(pattern), got))
        return F.coalesce(*hits)

    def first(field: str) -> Column:
        at = F.when(F.col(f"_{field}").isNotNull(), F.struct("page_no", "line_no", f"_{field}"))
        return F.min(at)[f"_{field}"].alias(field)

    candidates = lines.filter(F.col("page_no") <= max_pages).select(
        "document_id", "page_no", "line_no", *[found(f).alias(f"_{f}") for f in rules]
    )
    return candidates.groupBy("document_id").agg(*[first(f) for f in rules])


def apply_corrections(documents: DataFrame, edits: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Let each document's latest non-null user edit of a field override the stored value.

    ``edits`` is (document_id, field, value, edited_at); an edit to null changes nothing.
    """
    wanted = edits.filter(F.col("field").isin(list(fields)) & F.col("value").isNotNull())
    newest = latest(wanted, ["document_id", "field"], ["edited_at", "value"])
    wide = newest.groupBy(F.col("document_id").alias("id")).agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"_{f}") for f in fields]
    )
    types = dict(documents.dtypes)
    merged = documents.join(wide, "id", "left")
    return merged.select(
        *[
            F.coalesce(F.col(f"_{c}").cast(types[c]), F.col(c)).alias(c) if c in fields else F.col(c)
            for c in documents.columns
        ]
    )


def content_ref(df: DataFrame, bytes_col: str, out: str = "content_ref") -> DataFrame:
    """Add the reference derived from the bytes in ``bytes_col``."""
    return df.withColumn(out, content_ref_of(bytes_col))


def dedupe_uploads(
    uploads: DataFrame, bytes_col: str = "content", order_by: Sequence[str] = ("uploaded_at", "id")
) -> DataFrame:
    """Keep each owner's earliest upload of the same bytes. Only the reference is shuffled on, not the bytes."""
    keyed = content_ref(uploads, bytes_col).drop(bytes_col)
    return keep_first(keyed, ["user_id", "content_ref"], [as_column(c) for c in order_by])
