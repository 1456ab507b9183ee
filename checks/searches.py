"""Similarity search, context, citations and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.inputs import SQL_VIEWS, Inputs
from checks.registry import query
from ledgerloom.operators import citations, evaluation, models, pq, search
from ledgerloom.plans import answer_contexts, answer_questions, ingest_documents
from ledgerloom.session import cut_lineage

DIM = 64
# Two fixed directions made by rule, the same in SQL.
VECTOR_A = [float(i * 7 % 13 - 6) for i in range(DIM)]
VECTOR_B = [float(i * 5 % 11 - 5) for i in range(DIM)]
SQL_A = "list_transform(generate_series(0, 63), lambda i: CAST(i * 7 % 13 - 6 AS DOUBLE))"
SQL_B = "list_transform(generate_series(0, 63), lambda i: CAST(i * 5 % 11 - 5 AS DOUBLE))"
HITS = "qid, id, document_id, section, page_start, page_end, company, fiscal_period, score, rank"


@query(
    "e1_vector_search",
    f"""SELECT id, document_id, section, company, round(list_cosine_similarity(embedding, {SQL_A}), 6) + 0.0 AS score FROM vec_chunks
    WHERE user_id = 'u1' ORDER BY score DESC, id LIMIT 20""",
)
def e1(t: Inputs) -> DataFrame:
    return search.vector_search(t.vec_chunks, VECTOR_A, 20, "u1").select("id", "document_id", "section", "company", "score")


E2 = f"SELECT {HITS} FROM vec_ranked WHERE rank <= 8"


def _columns(hits: DataFrame) -> DataFrame:
    return hits.select(*HITS.split(", "))


@query("e2_batch_vector_search", E2)
def e2(t: Inputs) -> DataFrame:
    return _columns(search.batch_vector_search(t.vec_questions, t.vec_chunks, 8))


@query("e2_batch_vector_search_blocks", E2)
def e2_blocks(t: Inputs) -> DataFrame:
    return _columns(search.batch_vector_search(t.vec_questions, t.vec_chunks, 8, max_sent=0, v_block=100, q_block=60))


@query("e3_ann_search_all_lists", "SELECT qid, id, score, rank FROM vec_ranked WHERE rank <= 8")
def e3_all(t: Inputs) -> DataFrame:
    index = search.build_ivf(t.vec_chunks.select("id", "document_id", "user_id", "embedding"), 8, max_iter=5)
    return search.ann_search(t.vec_questions, index, 8, n_probe=8).select("qid", "id", "score", "rank")


def _enough(recall: DataFrame) -> DataFrame:
    """The recall, or an error if it is below nine tenths."""
    failed = F.raise_error(F.concat(F.lit("recall is only "), F.col("recall").cast("string"))).cast("boolean")
    return recall.select("exact_hits", F.when(F.col("recall") >= 0.9, F.lit(True)).otherwise(failed).alias("enough"))


RECALL = "SELECT COUNT(*) AS exact_hits, TRUE AS enough FROM vec_ranked WHERE rank <= 8"


@query("e3_ann_recall", RECALL)
def e3_recall(t: Inputs) -> DataFrame:
    vectors = t.vec_chunks.select("id", "document_id", "user_id", "embedding")
    lists = pq.lists_for(vectors.count())
    index = search.build_ivf(vectors, lists, max_iter=5)
    near = search.ann_search(t.vec_questions, index, 8, n_probe=lists * 3 // 4)
    return _enough(search.recall_at_k(near, search.batch_vector_search(t.vec_questions, vectors, 8, payload=False)))


@query("e3_pq_recall", RECALL)
def e3_pq(t: Inputs) -> DataFrame:
    vectors = t.vec_chunks.select("id", "document_id", "user_id", "embedding")
    index = pq.build_pq(vectors)
    near = pq.pq_search(t.vec_questions, index, vectors, 8, n_probe=len(index.centroids) * 2 // 5)
    return _enough(search.recall_at_k(near, search.batch_vector_search(t.vec_questions, vectors, 8, payload=False)))


@query(
    "e4_retrieve_with_policy",
    """WITH best AS (SELECT qid, max(score) AS best FROM vec_ranked GROUP BY qid),
    kept AS (SELECT r.qid, r.id, r.score, r.rank, CASE WHEN best >= 0.6 THEN 'ok' ELSE 'weak' END AS verdict FROM vec_ranked r JOIN best b ON b.qid = r.qid
      WHERE (best >= 0.6 AND rank <= 2) OR (best < 0.6 AND best >= 0.2 AND rank <= 5))
    SELECT q.qid, k.id, k.score, k.rank, COALESCE(k.verdict, 'not_found') AS verdict FROM vec_questions q LEFT JOIN kept k ON k.qid = q.qid""",
)
def e4(t: Inputs) -> DataFrame:
    hits = search.retrieve_with_policy(t.vec_questions, t.vec_chunks, min_score=0.6, floor=0.2, k=2, k_wide=5)
    return hits.select("qid", "id", "score", "rank", "verdict")


@query(
    "e5_retrieve_by_dimension",
    f"""SELECT dimension, document_id, id, score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY dimension, document_id ORDER BY score DESC, id) AS rank FROM (
        SELECT 'risk' AS dimension, document_id, id, round(list_cosine_similarity(embedding, {SQL_A}), 6) + 0.0 AS score FROM vec_chunks
        UNION ALL SELECT 'guidance', document_id, id, round(list_cosine_similarity(embedding, {SQL_B}), 6) + 0.0 FROM vec_chunks)) WHERE rank <= 3""",
)
def e5(t: Inputs) -> DataFrame:
    hits = search.retrieve_by_dimension({"risk": VECTOR_A, "guidance": VECTOR_B}, t.vec_chunks, None, 3)
    return hits.select("dimension", "document_id", "id", "score", "rank")


@query(
    "e6_build_context",
    """WITH b AS (SELECT qid, rank, '[' || CAST(rank AS VARCHAR) || '] (' || company || ' ' || fiscal_period
        || CASE WHEN section IS NULL THEN '' ELSE ', ' || section END
        || CASE WHEN page_start IS NULL THEN '' WHEN page_start = page_end THEN ', p. ' || CAST(page_start AS VARCHAR) ELSE ', pp. ' || CAST(page_start AS VARCHAR) || '–' || CAST(page_end AS VARCHAR) END
        || '): ' || text AS block FROM vec_ranked WHERE rank <= 8)
    SELECT qid, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context, COUNT(*) AS blocks FROM b GROUP BY qid""",
)
def e6(t: Inputs) -> DataFrame:
    return citations.build_context(search.batch_vector_search(t.vec_questions, t.vec_chunks, 8))


@query(
    "e7_conversation_context",
    """WITH h AS (SELECT conv_id, turn, role, list(CAST(turn AS VARCHAR) || ' ' || CASE WHEN role = 'assistant' THEN 'model' ELSE role END || ' ' || md5(text))
        OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS items FROM conversations)
    SELECT conv_id AS conversation_id, turn, COALESCE(array_to_string(items, ','), '') AS history FROM h WHERE role = 'user'""",
)
def e7(t: Inputs) -> DataFrame:
    messages = t.table("conversations").selectExpr("conv_id as conversation_id", "turn", "role", "text as content")
    rows = citations.conversation_context(messages, max_turns=3, run_length=2)
    item = F.transform(
        "history", lambda m: F.concat_ws(" ", m["turn"].cast("string"), m["role"], F.md5(m["content"]))
    )
    return rows.select("conversation_id", "turn", F.array_join(item, ",").alias("history"))


@query(
    "e8_parse_citations",
    r"""WITH m AS (SELECT qid, regexp_extract_all(text, '\[(\d+)\]', 1) AS ms FROM marked_answers)
    SELECT qid, marker, TRY_CAST(marker AS INTEGER) AS n, CAST(list_position(ms, marker) AS INTEGER) AS position, CAST(len(list_filter(ms, lambda x: x = marker)) AS INTEGER) AS count
    FROM (SELECT qid, ms, unnest(list_distinct(ms)) AS marker FROM m)""",
)
def e8(t: Inputs) -> DataFrame:
    return citations.parse_citations(t.marked_answers.select("qid", "text"))


@query(
    "e9_validate_citations",
    r"""WITH m AS (SELECT qid, turn, text, regexp_extract_all(text, '\[(\d+)\]', 1) AS ms FROM marked_answers),
    c AS (SELECT qid, turn, text, list_distinct(list_filter(ms, lambda x: COALESCE(TRY_CAST(x AS INTEGER) BETWEEN 1 AND 1 + turn % 8, false))) AS known,
      list_distinct(list_filter(ms, lambda x: NOT COALESCE(TRY_CAST(x AS INTEGER) BETWEEN 1 AND 1 + turn % 8, false))) AS unknown FROM m)
    SELECT qid, md5(list_reduce(list_prepend(text, unknown), lambda a, x: replace(replace(a, ' [' || x || ']', ''), '[' || x || ']', ''))) AS text_md5,
      array_to_string(list_sort(list_transform(known, lambda x: qid || '/' || x)), ',') AS cited, CAST(len(unknown) AS INTEGER) AS unknown, len(known) = 0 AS uncited FROM c""",
)
def e9(t: Inputs) -> DataFrame:
    rows = citations.validate_citations(t.marked_answers, t.given_blocks)
    ids = F.array_sort(F.transform("citations", lambda c: c["chunk_id"]))
    return rows.select(
        "qid", F.md5("text").alias("text_md5"), F.array_join(ids, ",").alias("cited"), F.size("unknown").alias("unknown"), "uncited"
    )


# The search must leak nothing; a second search that ignores owners and scopes must be caught.
@query("e10_audit_leaks_none", "SELECT 'leaks' AS what, 0 AS n UNION ALL SELECT 'hits', COUNT(*) FROM vec_ranked WHERE rank <= 8")
def e10(t: Inputs) -> DataFrame:
    hits = search.batch_vector_search(t.vec_questions, t.vec_chunks, 8, payload=False)
    leaks = evaluation.audit_leaks(hits, t.vec_questions, t.vec_chunks)
    return leaks.agg(F.lit("leaks").alias("what"), F.count(F.lit(1)).alias("n")).unionByName(
        hits.agg(F.lit("hits").alias("what"), F.count(F.lit(1)).alias("n"))
    )


@query(
    "e10_audit_leaks_found",
    """WITH leaky AS (SELECT vec_id AS qid, 'u' || CAST((label + vec_id % 2) % 3 AS VARCHAR) AS searched, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings),
    h AS (SELECT l.qid, c.id, c.user_id AS owner, c.document_id FROM leaky l JOIN vec_chunks c ON c.user_id = l.searched
      QUALIFY row_number() OVER (PARTITION BY l.qid ORDER BY round(list_cosine_similarity(l.embedding, c.embedding), 6) DESC, c.id) <= 8)
    SELECT h.qid, h.id, CASE WHEN h.owner <> q.user_id THEN 'foreign_chunk' ELSE 'outside_scope' END AS problem
    FROM h JOIN vec_questions q ON q.qid = h.qid
    WHERE h.owner <> q.user_id OR NOT COALESCE(list_contains(q.document_ids, h.document_id), true)""",
)
def e10_found(t: Inputs) -> DataFrame:
    leaky = t.table("embeddings").selectExpr(
        "vec_id as qid", "concat('u', (label + vec_id % 2) % 3) as user_id", "embedding", "cast(null as array<string>) as document_ids"
    )
    hits = search.batch_vector_search(leaky, t.vec_chunks, 8, payload=False)
    return evaluation.audit_leaks(hits, t.vec_questions, t.vec_chunks).select("qid", "id", "problem")


# Expected: the three chunks of the question's own document that fit best. Given: the five best hits
# within the question's scope, citing two of them.
@query(
    "e11_evaluate",
    """WITH want AS (SELECT qid, list(CAST(id AS VARCHAR)) AS want FROM (SELECT q.id AS qid, c.id FROM vec_chunks c JOIN vec_chunks q ON q.document_id = c.document_id
      QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.embedding, c.embedding), 6) DESC, c.id) <= 3) GROUP BY qid),
    got AS (SELECT qid, list(CAST(id AS VARCHAR) ORDER BY rank) AS got FROM vec_ranked WHERE rank <= 5 GROUP BY qid),
    j AS (SELECT w.qid, want, COALESCE(got, []) AS got, COALESCE(len(document_ids) = 0, false) AS must_refuse, got IS NULL AS refused, list_slice(COALESCE(got, []), 1, 2) AS cited
      FROM want w JOIN vec_questions q ON q.qid = w.qid LEFT JOIN got g ON g.qid = w.qid),
    p AS (SELECT qid, CASE WHEN NOT must_refuse THEN CAST(len(list_intersect(got, want)) > 0 AS DOUBLE) END AS hit,
      CASE WHEN NOT must_refuse THEN len(list_intersect(got, want)) / len(want) END AS recall,
      CASE WHEN NOT must_refuse THEN COALESCE(1.0 / list_min(list_filter(list_transform(want, lambda w: list_position(got, w)), lambda x: x > 0)), 0.0) END AS reciprocal_rank,
      CASE WHEN NOT must_refuse AND len(cited) > 0 THEN len(list_intersect(cited, want)) / len(cited) END AS citation_precision,
      CASE WHEN NOT must_refuse THEN len(list_intersect(cited, want)) / len(want) END AS citation_recall,
      CAST(refused = must_refuse AS DOUBLE) AS refusal_correct,
      CAST(CASE WHEN must_refuse THEN refused ELSE NOT refused AND len(list_intersect(cited, want)) > 0 AND len(list_intersect(cited, want)) = len(cited) END AS DOUBLE) AS passed FROM j)
    SELECT qid, CAST(grouping(qid) AS INTEGER) AS is_total, round(avg(hit), 6) AS hit, round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS reciprocal_rank,
      round(avg(citation_precision), 6) AS citation_precision, round(avg(citation_recall), 6) AS citation_recall, round(avg(refusal_correct), 6) AS refusal_correct, round(avg(passed), 6) AS passed
    FROM p GROUP BY ROLLUP (qid)""",
)
def e11(t: Inputs) -> DataFrame:
    hits = search.batch_vector_search(t.vec_questions, t.vec_chunks, 5, payload=False)
    ranked = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id")))).alias("h"))
    results = ranked.select(
        "qid", F.transform("h", lambda h: h["id"]).alias("chunk_ids"),
        F.slice(F.transform("h", lambda h: h["id"]), 1, 2).alias("cited_ids"), F.lit(False).alias("refused"),
    )
    asked = t.vec_questions.select("qid", F.coalesce(F.size("document_ids") == 0, F.lit(False)).alias("must_refuse"))
    no_hit = asked.join(results, "qid", "left_anti").select(
        "qid", F.expr("cast(array() as array<string>)").alias("chunk_ids"), F.expr("cast(array() as array<string>)").alias("cited_ids"),
        F.lit(True).alias("refused"),
    )
    about = t.vec_chunks.selectExpr("id as qid", "user_id", "embedding", "array(document_id) as document_ids")
    best = search.batch_vector_search(about, t.vec_chunks, 3, payload=False)
    own = best.groupBy("qid").agg(F.collect_list(F.col("id").cast("string")).alias("chunk_ids"))
    expected = own.join(asked, "qid").select("qid", "chunk_ids", "must_refuse")
    report = evaluation.evaluate(results.unionByName(no_hit), expected, 5)
    return report.select("qid", "is_total", *[F.round(c, 6).alias(c) for c in report.columns if c not in ("qid", "is_total")])


# Extracted figures are rounded to whole units and take accepted lines for returned ones; revenue is
# extracted from reports with returns.
@query(
    "e12_evaluate_metrics",
    """WITH x AS (SELECT document_id, revenue, cost_of_revenue, returned, returned_or_accepted, return_lines, lines FROM report_figures),
    got AS (SELECT document_id, 'revenue' AS metric, CAST(round(revenue, 0) AS DECIMAL(28,4)) AS value FROM x WHERE return_lines > 0
      UNION ALL SELECT document_id, 'cost_of_revenue', CAST(CASE WHEN lines % 3 = 0 THEN cost_of_revenue * 2 ELSE cost_of_revenue END AS DECIMAL(28,4)) FROM x
      UNION ALL SELECT document_id, 'returned', CAST(returned_or_accepted AS DECIMAL(28,4)) FROM x),
    gold AS (SELECT document_id, 'revenue' AS metric, CAST(revenue AS DECIMAL(28,4)) AS value FROM x
      UNION ALL SELECT document_id, 'cost_of_revenue', CAST(cost_of_revenue AS DECIMAL(28,4)) FROM x
      UNION ALL SELECT document_id, 'returned', CAST(returned AS DECIMAL(28,4)) FROM x),
    j AS (SELECT COALESCE(a.metric, b.metric) AS metric, a.value AS got, b.value AS gold FROM got a FULL JOIN gold b ON a.document_id = b.document_id AND a.metric = b.metric)
    SELECT metric, count_if(gold IS NOT NULL AND got IS NOT NULL AND got = gold) AS exact,
      count_if(gold IS NOT NULL AND got IS NOT NULL AND got <> gold AND abs(got - gold) <= abs(gold) * 0.01) AS within_tolerance,
      count_if(gold IS NOT NULL AND got IS NOT NULL AND got <> gold AND abs(got - gold) > abs(gold) * 0.01) AS wrong,
      count_if(gold IS NOT NULL AND got IS NULL) AS missing, count_if(gold IS NULL AND got IS NOT NULL) AS invented, count_if(gold IS NULL AND got IS NULL) AS agreed_null
    FROM j GROUP BY metric""",
)
def e12(t: Inputs) -> DataFrame:
    figures = t.report_figures
    gold = figures.selectExpr(
        "document_id",
        "stack(3, 'revenue', cast(revenue as decimal(28,4)), 'cost_of_revenue', cast(cost_of_revenue as decimal(28,4)), "
        "'returned', cast(returned as decimal(28,4))) as (metric, value)",
    )
    got = figures.selectExpr(
        "document_id", "return_lines",
        "stack(3, 'revenue', cast(round(revenue, 0) as decimal(28,4)), "
        "'cost_of_revenue', cast(case when lines % 3 = 0 then cost_of_revenue * 2 else cost_of_revenue end as decimal(28,4)), "
        "'returned', cast(returned_or_accepted as decimal(28,4))) as (metric, value)",
    ).filter("metric <> 'revenue' or return_lines > 0")
    return evaluation.evaluate_metrics(got, gold, 0.01)


@query("flow_answer_contexts")
def flow_answers(t: Inputs) -> DataFrame:
    questions = t.table("conversations").filter("role = 'user'").selectExpr(
        "concat(conv_id, '-', turn) as qid", "concat('u', conv_id % 20) as user_id", "text",
        "cast(null as array<string>) as document_ids",
    )
    # The index is stored once, as in a library, and then ranked and read.
    return answer_contexts(questions, cut_lineage(ingest_documents(t.lib_documents)))


def counting_model(question: str, history: str, context: str) -> str:
    """Says how many blocks it was given and cites the first one and one that it was not given."""
    blocks = len(context.split("\n\n"))
    if question.endswith("7"):
        raise models.ModelError("refusal", "declined", code=422)
    return f"{question} has {blocks} blocks [1] so [{blocks + 1}]."


def _answers(t: Inputs):
    questions = t.vec_questions.selectExpr(
        "qid", "concat('c', qid % 50) as conversation_id", "user_id", "concat('question ', qid) as text", "embedding", "document_ids",
        "timestamp_seconds(qid) as asked_at",
    )
    return answer_questions(questions, t.vec_chunks, counting_model, 0.3, 0.2, "checks", "counting", k=2, k_wide=5)


SQL_VIEWS["told"] = """
WITH best AS (SELECT qid, max(score) AS best FROM vec_ranked GROUP BY qid),
v AS (SELECT q.qid, q.user_id, CASE WHEN best >= 0.3 THEN 'ok' WHEN best >= 0.2 THEN 'weak' ELSE 'not_found' END AS verdict FROM vec_questions q LEFT JOIN best b ON b.qid = q.qid),
n AS (SELECT v.qid, count(*) AS blocks, max(CASE WHEN r.rank = 1 THEN r.id END) AS first FROM v JOIN vec_ranked r ON r.qid = v.qid AND r.rank <= CASE verdict WHEN 'ok' THEN 2 WHEN 'weak' THEN 5 ELSE 0 END GROUP BY v.qid)
SELECT v.*, n.blocks, n.first, 'question ' || CAST(v.qid AS VARCHAR) AS question,
  CASE WHEN verdict = 'not_found' THEN 'not_found' WHEN v.qid % 10 = 7 THEN 'refusal' ELSE 'ok' END AS outcome FROM v LEFT JOIN n ON n.qid = v.qid"""


@query(
    "flow_answer_questions",
    """SELECT qid, verdict, outcome, CAST(verdict <> 'not_found' AS INTEGER) AS calls,
      CASE outcome WHEN 'not_found' THEN 'not found in the selected reports' WHEN 'ok' THEN question || ' has ' || CAST(blocks AS VARCHAR) || ' blocks [1] so.' END AS text,
      CASE WHEN outcome = 'ok' THEN CAST(first AS VARCHAR) END AS cited, CASE WHEN outcome = 'ok' THEN CAST(blocks + 1 AS VARCHAR) END AS unknown FROM told""",
)
def flow_answers_told(t: Inputs) -> DataFrame:
    ids = F.array_join(F.transform("citations", lambda c: c["chunk_id"]), ",")
    rows = _answers(t).answers
    return rows.select("qid", "verdict", "outcome", "calls", "text", ids.alias("cited"), F.array_join("unknown", ",").alias("unknown"))


@query(
    "flow_answer_records",
    """SELECT 'message' AS part, 'c' || CAST(qid % 50 AS VARCHAR) AS owner, 'user' AS role, COUNT(*) AS n, CAST(SUM(length(question)) AS BIGINT) AS size FROM told GROUP BY qid % 50
    UNION ALL SELECT 'message', 'c' || CAST(qid % 50 AS VARCHAR), 'assistant', COUNT(*), CAST(SUM(length(CASE outcome WHEN 'ok' THEN question || ' has ' || CAST(blocks AS VARCHAR) || ' blocks [1] so.' ELSE 'not found in the selected reports' END)) AS BIGINT)
      FROM told WHERE outcome <> 'refusal' GROUP BY qid % 50
    UNION ALL SELECT 'usage', user_id, 'llm', COUNT(*), CAST(SUM(CASE WHEN outcome = 'ok' THEN 8 ELSE 0 END) AS BIGINT) FROM told WHERE outcome <> 'not_found' GROUP BY user_id""",
)
def flow_answer_records(t: Inputs) -> DataFrame:
    made = _answers(t)
    messages = made.messages.groupBy(F.lit("message").alias("part"), F.col("conversation_id").alias("owner"), "role").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("size")
    )
    usage = made.usage.groupBy(F.lit("usage").alias("part"), F.col("user_id").alias("owner"), F.col("kind").alias("role")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens_out").alias("size")
    )
    return messages.unionByName(usage)
