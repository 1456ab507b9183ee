"""Text to chunks, metadata, embeddings and model application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.inputs import SQL_VIEWS, Inputs
from checks.registry import query
from ledgerloom.functions import token_count
from ledgerloom.operators import layout, models, text

# In the driver texts a line of at most three words stands for a heading; its case tells which.
HEADINGS = {
    "Short": r"^\S+$",
    "Pair": r"^\S+\s\S+$",
    "Triple": r"^\S+\s\S+\s\S+$",
}
SQL_VIEWS["doc_lines"] = """
SELECT id AS document_id, CAST((line_no - 1) // 40 + 1 AS INTEGER) AS page_no, CAST(line_no AS INTEGER) AS line_no, line
FROM (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM lib_documents)"""
SQL_VIEWS["doc_sections"] = r"""
SELECT document_id, page_no, line_no, line, last_value(heading IGNORE NULLS) OVER w AS section,
  CASE WHEN count(heading) OVER (PARTITION BY document_id) > 0 THEN count(heading) OVER w ELSE (page_no - 1) // 5 END AS section_no
FROM (SELECT *, CASE WHEN regexp_full_match(line, '\S+') THEN 'Short' WHEN regexp_full_match(line, '\S+\s\S+') THEN 'Pair'
  WHEN regexp_full_match(line, '\S+\s\S+\s\S+') THEN 'Triple' END AS heading FROM doc_lines)
WINDOW w AS (PARTITION BY document_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
SQL_VIEWS["section_words"] = r"""
SELECT document_id, section_no, section, page_no, word, row_number() OVER (PARTITION BY document_id, section_no ORDER BY line_no, i) - 1 AS pos,
  count(*) OVER (PARTITION BY document_id, section_no) AS n
FROM (SELECT document_id, section_no, section, page_no, line_no, unnest(words) AS word, generate_subscripts(words, 1) AS i
  FROM (SELECT *, list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '') AS words FROM doc_sections))"""
SQL_VIEWS["chunk_rows"] = """
SELECT document_id, section, page_start, page_end, text, token_count, row_number() OVER (PARTITION BY document_id ORDER BY section_no, start) - 1 AS chunk_index
FROM (SELECT document_id, section_no, start, any_value(section) AS section, min(page_no) AS page_start, max(page_no) AS page_end,
    string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS token_count
  FROM section_words JOIN (SELECT document_id AS d, section_no AS s, unnest(generate_series(0, greatest(0, n - 21), 100)) AS start
      FROM (SELECT DISTINCT document_id, section_no, n FROM section_words))
    ON d = document_id AND s = section_no AND pos >= start AND pos < start + 120
  GROUP BY document_id, section_no, start)"""
CHUNKS = """SELECT sha256(document_id || '|' || CAST(chunk_index AS VARCHAR)) AS id, document_id, section, page_start, page_end,
  token_count, chunk_index, md5(text) AS text_md5 FROM chunk_rows"""


def _shown(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "id", "document_id", "section", "page_start", "page_end", "token_count", "chunk_index", F.md5("text").alias("text_md5")
    )


@query("c1_split_pages", "SELECT document_id, page_no, line_no, md5(line) AS line_md5 FROM doc_lines")
def c1(t: Inputs) -> DataFrame:
    return text.split_pages(t.lib_documents).select("document_id", "page_no", "line_no", F.md5("line").alias("line_md5"))


@query(
    "c2_detect_sections",
    "SELECT document_id, line_no, page_no, section, CAST(section_no AS INTEGER) AS section_no FROM doc_sections",
)
def c2(t: Inputs) -> DataFrame:
    lines = text.split_pages(t.lib_documents)
    return text.detect_sections(lines, HEADINGS).select("document_id", "line_no", "page_no", "section", "section_no")


@query("c3_chunk_windows", CHUNKS)
def c3(t: Inputs) -> DataFrame:
    lines = text.detect_sections(text.split_pages(t.lib_documents), HEADINGS)
    return _shown(text.chunk_windows(lines, target=120, overlap=20))


@query("c3_chunk_documents", CHUNKS)
def c3_narrow(t: Inputs) -> DataFrame:
    return _shown(text.chunk_documents(t.lib_documents, HEADINGS, target=120, overlap=20))


# Order lines as tables: one table per order, one row per line, three columns, a pipe in the first.
@query(
    "c4_tables_to_markdown",
    """WITH lines AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_no,
        '| ' || l_returnflag || '\\|' || l_linestatus || ' | ' || CASE WHEN l_discount = 0 THEN '' ELSE CAST(l_partkey AS VARCHAR) END || ' | ' || CAST(l_suppkey AS VARCHAR) || ' |' AS line FROM lineitem)
    SELECT l_orderkey AS document_id, md5(string_agg(CASE WHEN row_no = 1 THEN line || chr(10) || '| --- | --- | --- |' ELSE line END, chr(10) ORDER BY row_no)) AS markdown_md5
    FROM lines GROUP BY l_orderkey""",
)
def c4(t: Inputs) -> DataFrame:
    lines = t.table("lineitem").withColumnRenamed("l_orderkey", "document_id").withColumn(
        "row_no",
        F.expr("row_number() over (partition by document_id order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)"),
    )
    rows = lines.selectExpr(
        "document_id", "1 as page_no", "1 as table_no", "row_no",
        _cells("concat(l_returnflag, '|', l_linestatus)", "case when l_discount = 0 then null else cast(l_partkey as string) end", "cast(l_suppkey as string)"),
    )
    return text.tables_to_markdown(rows, together=True).select("document_id", F.md5("markdown").alias("markdown_md5"))


def _cells(*values: str) -> str:
    """The cells of a table's row, from the first column on."""
    named = (f"named_struct('col_no', {n}, 'value', {v})" for n, v in enumerate(values, 1))
    return f"array({', '.join(named)}) as cells"


# Order lines as tables of the suppliers' documents: one table per line number, every second one behind a line of text.
SQL_VIEWS["report_rows"] = """
SELECT CAST(l_suppkey AS VARCHAR) AS document_id, CAST(1 + l_linenumber % 3 AS INTEGER) AS page_no, CASE WHEN l_linenumber % 2 = 0 THEN 6 * l_linenumber END AS after_line,
  l_linenumber AS table_no, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_extendedprice, l_returnflag, l_linestatus, l_discount) AS row_no,
  l_returnflag || '|' || l_linestatus AS flag, CASE WHEN l_discount > 0 THEN CAST(l_partkey AS VARCHAR) END AS part, CAST(l_orderkey AS VARCHAR) AS orderkey
FROM lineitem"""
SQL_VIEWS["report_units"] = """
WITH elements AS (
  SELECT document_id, page_no, CAST(line_no AS DOUBLE) AS pos, 0 AS kind, 0 AS table_no, 0 AS row_no, line, CASE WHEN regexp_full_match(line, '\\S+') THEN 'Short'
    WHEN regexp_full_match(line, '\\S+\\s\\S+') THEN 'Pair' WHEN regexp_full_match(line, '\\S+\\s\\S+\\s\\S+') THEN 'Triple' END AS heading FROM doc_lines
  UNION ALL SELECT document_id, page_no, COALESCE(CAST(after_line AS DOUBLE), 1e18), 1, table_no, row_no,
    '| ' || replace(flag, '|', '\\|') || ' | ' || COALESCE(part, '') || ' | ' || orderkey || ' |', NULL FROM report_rows SEMI JOIN lib_documents d ON d.id = document_id
  UNION ALL SELECT DISTINCT document_id, page_no, COALESCE(CAST(after_line AS DOUBLE), 1e18), 1, table_no, 0, '| Flag | Part | Order |' || chr(10) || '| --- | --- | --- |', NULL
    FROM report_rows SEMI JOIN lib_documents d ON d.id = document_id),
placed AS (
  SELECT *, last_value(heading IGNORE NULLS) OVER w AS section, CASE WHEN count(heading) OVER (PARTITION BY document_id) > 0 THEN count(heading) OVER w ELSE (page_no - 1) // 5 END AS section_no
  FROM elements WINDOW w AS (PARTITION BY document_id ORDER BY page_no, pos, kind, table_no, row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
units AS (
  SELECT document_id, section_no, section, page_no, pos, kind, table_no, row_no, i, unit, CASE kind WHEN 0 THEN 1 ELSE len(list_filter(regexp_split_to_array(unit, '\\s+'), lambda w: w <> '')) END AS size
  FROM (SELECT *, unnest(parts) AS unit, generate_subscripts(parts, 1) AS i
    FROM (SELECT *, CASE kind WHEN 0 THEN list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '') ELSE [line] END AS parts FROM placed)))
SELECT document_id, section_no, section, page_no, kind, unit, size, CASE WHEN kind = 1 AND row_no > 0 THEN 14 ELSE 0 END AS header, row_number() OVER w - 1 AS idx,
  CAST(sum(size) OVER w - size AS BIGINT) AS before FROM units
WINDOW w AS (PARTITION BY document_id, section_no ORDER BY page_no, pos, kind, table_no, row_no, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@query(
    "c3_chunk_tables",
    """WITH RECURSIVE u AS MATERIALIZED (SELECT * FROM report_units),
    edge AS MATERIALIZED (SELECT document_id, section_no, idx, before FROM u
      UNION ALL SELECT document_id, section_no, max(idx) + 1, max(before + size) FROM u GROUP BY 1, 2),
    whole AS (SELECT document_id, section_no, max(idx) AS n FROM edge GROUP BY 1, 2),
    room AS (SELECT document_id, section_no, before - header AS room, min(idx) AS idx FROM u GROUP BY 1, 2, 3),
    ends AS (SELECT u.document_id, u.section_no, u.idx, greatest(u.idx + 1, e.idx) AS stop
      FROM u ASOF JOIN edge e ON e.document_id = u.document_id AND e.section_no = u.section_no AND u.before + 120 - u.header >= e.before),
    at_end AS (SELECT s.document_id, s.section_no, s.idx, s.stop, a.before, b.before AS after
      FROM ends s JOIN edge a ON a.document_id = s.document_id AND a.section_no = s.section_no AND a.idx = s.stop
      LEFT JOIN edge b ON b.document_id = s.document_id AND b.section_no = s.section_no AND b.idx = s.stop + 1),
    back AS (SELECT s.*, e.idx AS back FROM at_end s ASOF JOIN edge e ON e.document_id = s.document_id AND e.section_no = s.section_no AND s.before - 20 <= e.before),
    step AS MATERIALIZED (SELECT s.document_id, s.section_no, s.idx, s.stop, CASE WHEN s.after IS NOT NULL THEN least(greatest(s.back, COALESCE(r.idx, s.stop), s.idx + 1), s.stop) END AS next
      FROM back s ASOF LEFT JOIN room r ON r.document_id = s.document_id AND r.section_no = s.section_no AND s.after - 120 <= r.room),
    w AS (SELECT document_id, section_no, idx, stop, next FROM step WHERE idx = 0
      UNION ALL SELECT s.document_id, s.section_no, s.idx, s.stop, s.next FROM w JOIN step s ON s.document_id = w.document_id AND s.section_no = w.section_no AND s.idx = w.next),
    c AS (SELECT w.document_id, w.section_no, w.idx, any_value(u.section) AS section, min(u.page_no) AS page_start, max(u.page_no) AS page_end, sum(u.size) + max(CASE WHEN u.idx = w.idx THEN u.header END) AS token_count,
        max(CASE WHEN u.idx = w.idx AND u.header > 0 THEN '| Flag | Part | Order |' || chr(10) || '| --- | --- | --- |' || chr(10) ELSE '' END) ||
        string_agg(CASE WHEN u.idx = w.idx THEN '' WHEN u.kind = 1 OR p.kind = 1 THEN chr(10) ELSE ' ' END || u.unit, '' ORDER BY u.idx) AS text
      FROM w JOIN u ON u.document_id = w.document_id AND u.section_no = w.section_no AND u.idx >= w.idx AND u.idx < w.stop
      LEFT JOIN u p ON p.document_id = u.document_id AND p.section_no = u.section_no AND p.idx = u.idx - 1 GROUP BY 1, 2, 3)
    SELECT document_id, section, page_start, page_end, CAST(token_count AS INTEGER) AS token_count,
      CAST(row_number() OVER (PARTITION BY document_id ORDER BY section_no, idx) - 1 AS INTEGER) AS chunk_index, md5(text) AS text_md5 FROM c""",
)
def c3_tables(t: Inputs) -> DataFrame:
    order = "l_orderkey, l_partkey, l_extendedprice, l_returnflag, l_linestatus, l_discount"
    lines = t.table("lineitem").selectExpr("cast(l_suppkey as string) as document_id", "l_linenumber as table_no", *order.split(", "))
    # Numbering the rows brings those of a table together, the one time that they travel; the first brings the header along.
    lines = lines.withColumn("row_no", F.expr(f"row_number() over (partition by document_id, table_no order by {order})"))
    line = _cells("concat(l_returnflag, '|', l_linestatus)", "case when l_discount > 0 then cast(l_partkey as string) end", "cast(l_orderkey as string)")
    row, header = f"struct(row_no, {line})", f"struct(0 as row_no, {_cells("'Flag'", "'Part'", "'Order'")})"
    rows = lines.selectExpr(
        "document_id", "1 + table_no % 3 as page_no", "table_no", "case when table_no % 2 = 0 then 6 * table_no end as after_line",
        f"inline(if(row_no = 1, array({header}, {row}), array({row})))",
    )
    tables = text.tables_to_markdown(rows, together=True)
    return _shown(layout.chunk_with_tables(t.lib_documents, tables, HEADINGS, target=120, overlap=20)).drop("id")


@query(
    "c5_enrich_chunks",
    """SELECT c.document_id, c.line_no, d.user_id, d.company, d.fiscal_period, d.report_type FROM doc_lines c JOIN lib_documents d ON d.id = c.document_id""",
)
def c5(t: Inputs) -> DataFrame:
    lines = text.split_pages(t.lib_documents).select("document_id", "line_no")
    return text.enrich_chunks(lines, t.lib_documents)


@query(
    "c6_detect_metadata",
    r"""WITH f AS (SELECT document_id, page_no, line_no,
        CASE WHEN regexp_matches(line, '(?i)(?:^| )the ([a-z]+)') THEN regexp_extract(line, '(?i)(?:^| )the ([a-z]+)', 1) WHEN regexp_matches(line, '(?:^| )(and|le|der|de)(?: |$)') THEN 'function word' END AS company,
        CASE WHEN regexp_matches(line, '(?i)^[aeiou]') THEN 'vowel' END AS report_type
      FROM doc_lines WHERE page_no <= 2)
    SELECT document_id, arg_min(company, line_no) FILTER (company IS NOT NULL) AS company, arg_min(report_type, line_no) FILTER (report_type IS NOT NULL) AS report_type
    FROM f GROUP BY document_id""",
)
def c6(t: Inputs) -> DataFrame:
    rules = {
        "company": ((r"(?i)(?:^| )the ([a-z]+)", None), (r"(?:^| )(and|le|der|de)(?: |$)", "function word")),
        "report_type": ((r"(?i)^[aeiou]", "vowel"),),
    }
    return text.detect_metadata(text.split_pages(t.lib_documents), rules, max_pages=2)


# Events are edits of the documents' company or currency; an error is an edit to null.
@query(
    "c7_apply_corrections",
    """WITH edits AS (SELECT CAST(user_id * 3 AS VARCHAR) AS document_id, CASE WHEN event_type IN ('view', 'click') THEN 'company' WHEN event_type = 'signup' THEN 'other' ELSE 'report_type' END AS field,
        CASE WHEN event_type <> 'error' THEN 'edit ' || CAST(event_id AS VARCHAR) END AS value, ts, event_id FROM events),
    newest AS (SELECT * FROM edits WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id, field ORDER BY ts DESC, value DESC) = 1)
    SELECT d.id, COALESCE(c.value, d.company) AS company, COALESCE(r.value, d.report_type) AS report_type, d.fiscal_period FROM lib_documents d
    LEFT JOIN newest c ON c.document_id = d.id AND c.field = 'company' LEFT JOIN newest r ON r.document_id = d.id AND r.field = 'report_type'""",
)
def c7(t: Inputs) -> DataFrame:
    edits = t.table("events").selectExpr(
        "cast(user_id * 3 as string) as document_id",
        "case when event_type in ('view', 'click') then 'company' when event_type = 'signup' then 'other' else 'report_type' end as field",
        "case when event_type <> 'error' then concat('edit ', event_id) end as value",
        "ts as edited_at",
    )
    docs = t.lib_documents.select("id", "company", "report_type", "fiscal_period")
    return text.apply_corrections(docs, edits, ["company", "report_type"])


@query(
    "c8_token_count",
    r"""SELECT id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS tokens FROM lib_documents""",
)
def c8(t: Inputs) -> DataFrame:
    return t.lib_documents.select("id", token_count("text").cast("bigint").alias("tokens"))


@query(
    "c9_content_ref",
    """SELECT id, 'fake-file-' || substr(sha256(text), 1, 16) AS content_ref FROM lib_documents""",
)
def c9(t: Inputs) -> DataFrame:
    docs = t.lib_documents.select("id", F.col("text").cast("binary").alias("content"))
    return text.content_ref(docs, "content").drop("content")


@query(
    "c9_dedupe_uploads",
    """SELECT source AS user_id, doc_id AS id, 'fake-file-' || substr(sha256(text), 1, 16) AS content_ref FROM documents
    QUALIFY row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) = 1""",
)
def c9_dedupe(t: Inputs) -> DataFrame:
    uploads = t.table("documents").selectExpr("source as user_id", "doc_id as id", "cast(text as binary) as content")
    return text.dedupe_uploads(uploads, order_by=("id",))


SQL_VIEWS["hash_raw"] = """
SELECT id, list_transform(generate_series(0, 19), lambda i: CAST(('0x' || substr(
    sha256(CAST(encode(text) AS BLOB) || unhex('0000000' || CAST(i // 8 AS VARCHAR))), CAST((i % 8) * 8 + 1 AS BIGINT), 8)) AS BIGINT) / 4294967296.0 * 2 - 1) AS v
FROM lib_documents"""


@query(
    "d1_hash_embed",
    """SELECT id, i AS pos, round(v[i] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) + 0.0 AS x
    FROM (SELECT id, v, unnest(generate_series(1, 20)) AS i FROM hash_raw)""",
)
def d1(t: Inputs) -> DataFrame:
    rows = models.hash_embed(t.lib_documents.select("id", "text"), dim=20)
    return rows.select("id", F.posexplode("embedding").alias("pos", "x")).select(
        "id", (F.col("pos") + 1).cast("bigint").alias("pos"), (F.round("x", 6) + 0.0).alias("x")
    )


@query(
    "d2_embed_batches",
    """SELECT id, i AS pos, round(v[i] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) + 0.0 AS x
    FROM (SELECT id, v, unnest(generate_series(1, 20)) AS i FROM hash_raw)""",
)
def d2(t: Inputs) -> DataFrame:
    rows = models.embed_batches(t.lib_documents.select("id", "text"), "text", models.HashModel(20), batch_size=64)
    return rows.select("id", F.posexplode("embedding").alias("pos", "x")).select(
        "id", (F.col("pos") + 1).cast("bigint").alias("pos"), (F.round("x", 6) + 0.0).alias("x")
    )


@query(
    "d2_embedding_usage",
    r"""SELECT user_id, 'embedding' AS kind, 'fake' AS provider, 'fake-embedding' AS model,
      CAST(sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))) AS BIGINT) AS tokens_in, 0 AS tokens_out FROM lib_documents GROUP BY user_id""",
)
def d2_usage(t: Inputs) -> DataFrame:
    return models.embedding_usage(t.lib_documents, "text", models.HashModel(16), by=["user_id"])


@query(
    "d3_vector_problems",
    """SELECT COUNT(*) AS vectors, count_if(len(embedding) <> 64) AS wrong_size, count_if(len(list_filter(embedding, lambda x: x IS NULL)) > 0) AS null_elements FROM embeddings""",
)
def d3(t: Inputs) -> DataFrame:
    return models.vector_problems(t.table("embeddings"), 64)


# A model whose answers follow from the row: it is busy twice, refuses, times out for good, fails, or breaks its JSON.
ODD_TURN = "(conv_id * 7 + turn) % 8"


def moody_model(structured: bool):
    calls: dict[tuple, int] = {}

    def answer(conv_id: str, turn: str, prompt: str) -> str:
        calls[conv_id, turn] = before = calls.get((conv_id, turn), -1) + 1
        mood = (int(conv_id) * 7 + int(turn)) % 8
        if mood == 1 and before < 2:
            raise models.ModelError("rate_limited", "busy", code=429, retry_after=0.5)
        if mood == 2:
            raise models.ModelError("refusal", "declined", code=422)
        if mood == 3:
            raise models.ModelError("unavailable", "timed out", code=504)
        if mood == 4 and prompt:
            raise TimeoutError("no answer")
        broken = mood == 5 and before == 0 or mood == 6
        if not structured:
            return f"answer to {len(prompt)} signs"
        return "{" if broken else f'{{"company": "c{conv_id}", "pages": {turn}, "revenue": null}}'

    return answer


WORDS_OF = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))"
SQL_VIEWS["generated"] = f"""
SELECT conv_id, turn, role, CASE WHEN m IN (2, 3, 4) THEN NULL ELSE 'answer to ' || length(text) || ' signs' END AS response,
  CASE m WHEN 2 THEN 'refusal' WHEN 3 THEN 'unavailable' WHEN 4 THEN 'error' ELSE 'ok' END AS outcome,
  CASE m WHEN 2 THEN 'declined' WHEN 3 THEN 'timed out' WHEN 4 THEN 'TimeoutError: no answer' END AS error,
  CAST(CASE m WHEN 1 THEN 3 WHEN 3 THEN 6 ELSE 1 END AS INTEGER) AS calls,
  CAST({WORDS_OF} + 2 AS INTEGER) AS tokens_in, CASE WHEN m IN (2, 3, 4) THEN 0 ELSE 4 END AS tokens_out
FROM (SELECT *, {ODD_TURN} AS m FROM conversations)"""


def _generated(t: Inputs, schema: T.StructType | None = None) -> DataFrame:
    prompts = ["conv_id", "turn", "text"]
    return models.batch_generate(t.table("conversations"), prompts, moody_model(schema is not None), schema=schema, sleep=lambda s: None)


@query("d4_batch_generate", "SELECT conv_id, turn, response, outcome, error, calls, tokens_in, tokens_out FROM generated")
def d4(t: Inputs) -> DataFrame:
    return _generated(t).select("conv_id", "turn", "response", "outcome", "error", "calls", "tokens_in", "tokens_out")


@query(
    "d4_batch_generate_structured",
    f"""SELECT conv_id, turn, CASE WHEN m IN (0, 1, 5, 7) THEN '{{"company": "c' || conv_id || '", "pages": ' || turn || ', "revenue": null}}' END AS response,
      CASE m WHEN 2 THEN 'refusal' WHEN 3 THEN 'unavailable' WHEN 4 THEN 'error' WHEN 6 THEN 'invalid_response' ELSE 'ok' END AS outcome,
      CAST(CASE m WHEN 1 THEN 3 WHEN 3 THEN 6 WHEN 5 THEN 2 WHEN 6 THEN 2 ELSE 1 END AS INTEGER) AS calls FROM (SELECT *, {ODD_TURN} AS m FROM conversations)""",
)
def d4_structured(t: Inputs) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("company", T.StringType(), False),
            T.StructField("pages", T.IntegerType(), False),
            T.StructField("revenue", T.DoubleType(), True),
        ]
    )
    return _generated(t, schema).select("conv_id", "turn", "response", "outcome", "calls")


@query(
    "d4_generation_usage",
    """SELECT role, 'llm' AS kind, 'checks' AS provider, 'moody' AS model, CAST(SUM(tokens_in) AS BIGINT) AS tokens_in, CAST(SUM(tokens_out) AS BIGINT) AS tokens_out
    FROM generated GROUP BY role""",
)
def d4_usage(t: Inputs) -> DataFrame:
    return models.generation_usage(_generated(t), "checks", "moody", by=["role"])


# The space that each index says it is in: recorded when it says nothing, kept when it fits, refused when it does not.
@query(
    "d3_space_guard",
    """SELECT label, CASE WHEN label % 3 = 0 THEN 'recorded' WHEN label % 3 = 1 THEN 'kept' ELSE 'refused' END AS verdict, COUNT(*) AS vectors FROM embeddings WHERE label IS NOT NULL GROUP BY label""",
)
def d3_guard(t: Inputs) -> DataFrame:
    vectors = t.table("embeddings").filter("label is not null")
    metas = vectors.select("label").distinct().filter("label % 3 <> 0").selectExpr(
        "label", "cast(1 as bigint) as id", "'acme' as embedding_provider", "if(label % 3 = 1, 'small', 'large') as embedding_model", "64 as dimension",
    )
    checked = models.space_verdicts(vectors.select("label").distinct(), metas, ["label"], "acme", "small", 64)
    return checked.join(vectors.groupBy("label").agg(F.count(F.lit(1)).alias("vectors")), "label")
