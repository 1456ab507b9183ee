"""Chunks of reports that hold tables between their lines of text.

A table stands at a place of its page and is packed row by row: a row is never split, and a chunk that
begins within a table repeats its header.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.text import (
    OVERLAP_TOKENS,
    PAGES_PER_GROUP,
    REPORT_HEADINGS,
    TARGET_TOKENS,
    _heading,
    chunk_id,
)

Unit = tuple[str, int, int, int, str]  # text, tokens, page, header's tokens if it must be repeated, header
CHUNK = pa.struct(
    [("section", pa.string()), ("page_start", pa.int32()), ("page_end", pa.int32()), ("text", pa.string()), ("token_count", pa.int32())]
)


def windows(sizes: Sequence[int], headers: Sequence[int], target: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(first, stop) of windows over whole units, which together hold every unit.

    A window takes units while they, and the header that its first unit needs, stay within ``target``;
    at least one. The next one goes back over the longest run of whole units of at most ``overlap``
    that leaves room for the unit after it, so no window consists of overlap alone.
    """
    before = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    # Never falls: a table's later rows need its header, which is as long as what stands before them.
    room = before[:-1] - np.asarray(headers, dtype=np.int64)
    n, first = len(sizes), 0
    while n:
        stop = max(first + 1, int(np.searchsorted(before, before[first] + target - headers[first], "right")) - 1)
        yield first, stop
        if stop == n:
            return
        back = int(np.searchsorted(before, before[stop] - overlap, "left"))
        fits = int(np.searchsorted(room, before[stop + 1] - target, "left"))
        first = min(max(back, fits, first + 1), stop)


def joined(units: Sequence[Unit]) -> str:
    """Words side by side, each row of a table on a line of its own."""
    parts: list[str] = []
    for i, (text, _, _, header, _) in enumerate(units):
        row = header >= 0
        if i:
            parts.append("\n" if row or units[i - 1][3] >= 0 else " ")
        parts.append(text)
    return "".join(parts)


def sections(
    lines: Sequence[tuple[int, str]], opened: Mapping[int, str], tables: Sequence[tuple]
) -> Iterator[tuple[str | None, list[Unit]]]:
    """Runs of units of one section, from (page, line) pairs, headings by line number, and tables in order."""
    order: list[tuple[tuple, str | None, tuple]] = [((page, no, 0, 0), None, (line,)) for no, (page, line) in enumerate(lines, 1)]
    for page, after, number, markdown in tables:
        order.append(((page, float("inf") if after is None else after, 1, number), markdown, ()))
    order.sort(key=lambda o: o[0])
    now: object = None
    name: str | None = None
    units: list[Unit] = []
    opened_so_far = 0
    for (page, no, *_), markdown, line in order:
        if markdown is None and no in opened:
            opened_so_far += 1
        here = opened_so_far if opened else (page - 1) // PAGES_PER_GROUP
        if here != now:
            if units:
                yield name, units
            now, units = here, []
            name = opened[no] if opened and markdown is None and no in opened else None
        if markdown is None:
            units += [(w, 1, page, -1, "") for w in line[0].split()]
            continue
        head, rule, *rows = markdown.split("\n")
        header = f"{head}\n{rule}"
        size = len(header.split())
        units.append((header, size, page, 0, ""))
        units += [(row, len(row.split()), page, size, header) for row in rows]
    if units:
        yield name, units


def chunk_with_tables(
    docs: DataFrame,
    tables: DataFrame,
    headings: Mapping[str, str] = REPORT_HEADINGS,
    target: int = TARGET_TOKENS,
    overlap: int = OVERLAP_TOKENS,
    lines_per_page: int | None = 40,
    page_sep: str | None = None,
    id_col: str = "id",
    text_col: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """:func:`chunk_documents` for documents with tables, as :func:`tables_to_markdown` gives them.

    ``tables`` is (document_id, page_no, table_no, markdown) and optionally ``after_line``, the number of
    the line of the document behind which the table stands on its page; without it the table stands at the page's end. A
    table belongs to the section it stands in. Tokens are words; a table's row is one unit of all its
    words and is never split, longer ones than ``target`` are a chunk of their own. A chunk that
    begins with a later row of a table has the table's header and rule in front, and they count. A document without tables
    gives the same chunks as :func:`chunk_documents`; one without text has those of its tables.

    A document's tables are brought together with its text by one join on the document's id. A document
    is the unit of work and is held by one task, as its text is one value anyway.
    """
    if not 0 <= overlap < target:
        raise ValueError("need 0 <= overlap < target")
    after = F.col("after_line").cast("bigint") if "after_line" in tables.columns else F.lit(None).cast("bigint")
    table = F.struct(
        F.col("page_no").cast("bigint").alias("page"), after.alias("after"), F.col("table_no").cast("bigint").alias("no"), "markdown"
    )
    placed = tables.groupBy(F.col("document_id").alias("_id")).agg(F.array_sort(F.collect_list(table)).alias("_tables"))
    line = F.split(F.replace(F.col(text_col), F.lit(page_sep), F.lit("\n")) if page_sep else F.col(text_col), "\n")
    named = F.transform(line, lambda ln, i: F.struct((i + 1).alias("no"), _heading(ln, headings).alias("name")))
    given = docs.select(
        F.col(id_col).alias("document_id"), *keep, F.col(text_col).alias("_text"), F.filter(named, lambda h: h["name"].isNotNull()).alias("_opened")
    )
    whole = given.join(placed, given["document_id"] == placed["_id"], "left").drop("_id").filter("_text is not null or _tables is not null")
    kept = len(given.columns) - 2
    names = [*whole.columns[:kept], "chunk_index", "_chunk"]
    per_page = lines_per_page or 40

    def pages(text: str) -> list[tuple[int, str]]:
        if page_sep is not None:
            return [(p, ln) for p, page in enumerate(text.split(page_sep), 1) for ln in page.split("\n")]
        return [(i // per_page + 1, ln) for i, ln in enumerate(text.split("\n"))]

    def chunks(text: str | None, opened: list | None, tables: list | None) -> list[dict]:
        lines = [] if text is None else pages(text)
        heads = {h["no"]: h["name"] for h in opened or []}
        found = []
        for name, units in sections(lines, heads, [(t["page"], t["after"], t["no"], t["markdown"]) for t in tables or []]):
            for first, stop in windows([u[1] for u in units], [max(u[3], 0) for u in units], target, overlap):
                mine = units[first:stop]
                repeated = mine[0][3] > 0
                body = joined(mine)
                found.append(
                    {
                        "section": name,
                        "page_start": mine[0][2],
                        "page_end": mine[-1][2],
                        "text": f"{mine[0][4]}\n{body}" if repeated else body,
                        "token_count": sum(u[1] for u in mine) + (mine[0][3] if repeated else 0),
                    }
                )
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                found = chunks(*(one.column(c)[0].as_py() for c in range(kept, kept + 3)))
                if found:
                    owner = pa.array(np.zeros(len(found), dtype=np.int64))
                    columns = [*(one.column(c).take(owner) for c in range(kept)), pa.array(range(len(found)), pa.int32()), pa.array(found, CHUNK)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [*whole.schema.fields[:kept], T.StructField("chunk_index", T.IntegerType())]
    chunk = T.StructType(
        [
            T.StructField("section", T.StringType()),
            T.StructField("page_start", T.IntegerType()),
            T.StructField("page_end", T.IntegerType()),
            T.StructField("text", T.StringType()),
            T.StructField("token_count", T.IntegerType()),
        ]
    )
    rows = whole.mapInArrow(run, T.StructType([*fields, T.StructField("_chunk", chunk)]))
    return rows.select(chunk_id().alias("id"), "document_id", *keep, "_chunk.*", "chunk_index")
