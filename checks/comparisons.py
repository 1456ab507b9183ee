"""Figures compared over periods, companies and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from checks.inputs import SQL_VIEWS, Inputs
from checks.registry import query
from checks.searches import SQL_A, SQL_B, VECTOR_A, VECTOR_B
from ledgerloom.operators import compare, search
from ledgerloom.plans import compare_reports

ORDINAL = "CAST(substr(fiscal_period, 1, 4) AS INTEGER) * 4 + CAST(substr(fiscal_period, 6, 1) AS INTEGER) - 1"
SQL_VIEWS["pairs"] = f"""
SELECT o.company, o.metric, o.document_id, o.period_no, o.value AS other_value, b.value AS base_value,
  o.unit AS other_unit, b.unit AS base_unit, o.currency AS other_currency, b.currency AS base_currency
FROM (SELECT *, {ORDINAL} AS period_no FROM report_metrics) o
LEFT JOIN (SELECT *, {ORDINAL} AS period_no FROM report_metrics) b ON b.company = o.company AND b.metric = o.metric AND b.period_no = o.period_no - 1"""
SQL_VIEWS["all_figures"] = f"""
SELECT *, {ORDINAL} AS period_no FROM (
  SELECT document_id, company, fiscal_period, metric, CAST(NULL AS VARCHAR) AS segment, value, unit, currency FROM report_metrics
  UNION ALL SELECT document_id, company, fiscal_period, 'segment_revenue', segment, value, unit, currency FROM report_segments)"""
SQL_VIEWS["all_pairs"] = """
SELECT COALESCE(o.company, b.company) AS company, COALESCE(o.metric, b.metric) AS metric, COALESCE(o.segment, b.segment) AS segment,
  COALESCE(o.document_id, b.later) AS document_id, o.value AS other_value, b.value AS base_value
FROM all_figures o FULL JOIN (
  SELECT f.*, r.document_id AS later FROM all_figures f
  JOIN (SELECT DISTINCT company, period_no, document_id FROM all_figures) r ON r.company = f.company AND r.period_no = f.period_no + 1) b
ON b.later = o.document_id AND b.metric = o.metric AND COALESCE(b.segment, '') = COALESCE(o.segment, '')"""
SQL_VIEWS["matrix_slots"] = """
SELECT company || '-' || substr(fiscal_period, 1, 4) AS comparison_id, CAST(substr(fiscal_period, 6, 1) AS INTEGER) AS slot, document_id FROM report_figures"""
SQL_VIEWS["mix"] = f"""
SELECT company, fiscal_period, segment, CAST(value AS DOUBLE) AS value, total, {ORDINAL} AS period_no, CAST(value AS DOUBLE) / CAST(total AS DOUBLE) AS share
FROM (SELECT *, SUM(value) OVER (PARTITION BY company, fiscal_period) AS total FROM report_segments)"""


def money(c: str) -> F.Column:
    return F.round(F.col(c).cast("double"), 4).alias(c)


# Every report is stored as a JSON analysis, next to an older one that must not be used.
def analyses(t: Inputs) -> DataFrame:
    def figure(value: str) -> F.Column:
        return F.struct(F.expr(value).cast("decimal(28,4)").alias("value"), "unit", "currency", F.col("first_line").cast("int").alias("source_page"))

    segment = F.struct(F.col("segment").alias("name"), "value", "unit", "currency", "source_page")
    segments = t.report_segments.groupBy("company", "fiscal_period").agg(F.array_sort(F.collect_list(segment)).alias("segments"))
    names = ("revenue", "cost_of_revenue", "gross_income", "operating_income", "free_cash_flow")
    wide = t.report_figures.join(segments, ["company", "fiscal_period"]).select(
        "document_id", "company", "fiscal_period", "segments",
        figure("revenue").alias("revenue"),
        figure("cost_of_revenue").alias("cost_of_revenue"),
        figure("revenue - cost_of_revenue").alias("gross_income"),
        figure("revenue - cost_of_revenue - taxes").alias("operating_income"),
        figure("revenue - returned").alias("free_cash_flow"),
    )
    result = F.to_json(F.struct("company", "fiscal_period", *names, "segments"))
    old = F.to_json(F.struct(F.lit("outdated").alias("company"), "fiscal_period"))
    versions = F.array(
        F.struct(F.lit(1).alias("v"), old.alias("result")), F.struct(F.lit(2).alias("v"), result.alias("result"))
    )
    return wide.select("document_id", F.inline(versions)).select(
        F.concat_ws("#", "document_id", "v").alias("id"),
        F.lit("metrics").alias("type"),
        F.array("document_id").alias("document_ids"),
        "result",
        F.timestamp_seconds(F.col("v")).alias("created_at"),
    )


@query(
    "f1_flatten_metrics",
    """SELECT document_id, company, fiscal_period, metric, NULL AS segment, round(CAST(value AS DOUBLE), 4) AS value, unit, currency, source_page FROM report_metrics
    UNION ALL SELECT document_id, company, fiscal_period, 'segment_revenue', segment, round(CAST(value AS DOUBLE), 4), unit, currency, source_page FROM report_segments""",
)
def f1(t: Inputs) -> DataFrame:
    return compare.flatten_metrics(analyses(t)).withColumn("value", money("value"))


# Every report repeats what the quarter before said, a little more where lines came back, and looks ahead in words;
# after the readable analysis follows a broken one.
def later_analyses(t: Inputs) -> DataFrame:
    # A company's reports lie together, one per quarter, so the quarter before is found in place.
    now = t.company_figures.withColumn("period_no", compare.quarter_ordinal(F.col("fiscal_period")))
    before = Window.partitionBy("company").orderBy("period_no")
    for name in ("period_no", "fiscal_period", "revenue"):
        now = now.withColumn(f"prior_{name}", F.lag(name).over(before))
    follows = "company is not null and prior_period_no = period_no - 1"

    def figure(value: str) -> F.Column:
        return F.struct(F.expr(value).cast("decimal(28,4)").alias("value"), "unit", "currency", F.col("first_line").cast("int").alias("source_page"))

    restated = "prior_revenue + if(return_lines > 0, 1, 0)"
    good = F.to_json(
        F.struct(
            "company", "fiscal_period", figure("revenue").alias("revenue"),
            F.when(F.expr(follows), F.struct(F.col("prior_fiscal_period").alias("fiscal_period"), figure(restated).alias("revenue"))).alias("prior"),
            F.array(F.struct(F.concat(F.lit("expects "), F.col("lines").cast("string"), F.lit(" lines")).alias("text"), F.col("first_line").cast("int").alias("source_page"))).alias("guidance"),
        )
    )
    rows = now.select("document_id", good.alias("good"))
    versions = F.array(F.struct(F.lit(1).alias("v"), F.col("good").alias("result")), F.struct(F.lit(2).alias("v"), F.left("good", F.lit(25)).alias("result")))
    return rows.select("document_id", F.inline(versions)).select(
        F.concat_ws("#", "document_id", "v").alias("id"), F.lit("metrics").alias("type"), F.array("document_id").alias("document_ids"),
        "result", F.timestamp_seconds(F.col("v")).alias("created_at"),
    )


@query(
    "f1_broken_analyses",
    """SELECT document_id, company, fiscal_period, round(CAST(revenue AS DOUBLE), 4) AS value, 'expects ' || CAST(lines AS VARCHAR) || ' lines' AS guidance, CAST(first_line AS INTEGER) AS source_page, FALSE AS missing FROM report_figures""",
)
def f1_broken(t: Inputs) -> DataFrame:
    stored = later_analyses(t)
    figures = compare.flatten_metrics(stored).filter("metric = 'revenue'").select("document_id", "company", "fiscal_period", money("value"))
    words = compare.flatten_guidance(stored).select("document_id", F.col("text").alias("guidance"), "source_page")
    lost = compare.missing_metrics(t.report_figures.select(F.col("document_id").alias("id")), stored).select(F.col("id").alias("document_id"), F.lit(True).alias("lost"))
    whole = figures.join(words, "document_id", "full_outer").join(lost, "document_id", "full_outer")
    return whole.withColumn("missing", F.coalesce("lost", F.lit(False))).drop("lost")


@query(
    "f1_restatements",
    f"""WITH r AS (SELECT *, {ORDINAL} AS period_no FROM report_figures)
    SELECT o.document_id, b.fiscal_period, b.document_id AS base_document_id, round(CAST(b.revenue + CASE WHEN o.return_lines > 0 THEN 1 ELSE 0 END AS DOUBLE), 4) AS other_value,
      CASE WHEN o.return_lines > 0 THEN 'restated' END AS flag, CASE WHEN o.return_lines > 0 THEN 1.0 ELSE 0.0 END AS delta
    FROM r o JOIN r b ON b.company = o.company AND b.period_no = o.period_no - 1""",
)
def f1_restated(t: Inputs) -> DataFrame:
    rows = compare.restatements(t.report_metrics, compare.flatten_comparatives(later_analyses(t)))
    return rows.select("document_id", "fiscal_period", "base_document_id", money("other_value"), "flag", F.col("delta").cast("double").alias("delta"))


@query(
    "f2_normalize_units",
    """SELECT document_id, metric, CASE WHEN value IS NOT NULL AND m.currency <> 'USD' AND r.rate IS NULL THEN 'missing_rate' END AS flag,
      CAST(CAST(CAST(value * CASE unit WHEN 'units' THEN 1 ELSE 1000 END AS DECIMAL(18,4)) * CASE WHEN m.currency = 'USD' THEN CAST(1 AS DECIMAL(10,2)) ELSE CAST(r.rate AS DECIMAL(10,2)) END AS DECIMAL(28,4)) AS DOUBLE) AS value
    FROM report_metrics m LEFT JOIN fx_rates r ON r.currency = m.currency AND r.fiscal_period = m.fiscal_period""",
)
def f2(t: Inputs) -> DataFrame:
    rows = compare.normalize_units(t.report_metrics, t.fx_rates)
    return rows.select("document_id", "metric", "flag", F.col("value").cast("double").alias("value"))


@query(
    "f3_metric_deltas",
    """SELECT company, metric, segment, document_id, round(CAST(base_value AS DOUBLE), 4) AS base_value, round(CAST(other_value AS DOUBLE), 4) AS other_value,
      CASE WHEN base_value IS NULL AND other_value IS NULL THEN 'missing_both' WHEN base_value IS NULL THEN 'missing_base' WHEN other_value IS NULL THEN 'missing_other' END AS flag,
      round(CAST(other_value - base_value AS DOUBLE), 4) AS delta,
      CASE WHEN base_value <> 0 THEN round(CAST(other_value - base_value AS DOUBLE) / abs(CAST(base_value AS DOUBLE)), 6) END AS growth FROM all_pairs""",
)
def f3(t: Inputs) -> DataFrame:
    rows = compare.period_deltas(t.company_all_metrics, compare.quarter_ordinal(F.col("fiscal_period")), together=True)
    return rows.select(
        "company", "metric", "segment", "document_id", money("base_value"), money("other_value"), "flag", money("delta"),
        F.round("growth", 6).alias("growth"),
    )


@query(
    "f4_growth_series",
    f"""WITH m AS MATERIALIZED (SELECT *, {ORDINAL} AS period_no FROM report_metrics)
    SELECT a.company, a.metric, a.fiscal_period, round(CAST(b.value AS DOUBLE), 4) AS previous, round(CAST(a.value - b.value AS DOUBLE), 4) AS delta,
      CASE WHEN b.value <> 0 THEN round(CAST(a.value - b.value AS DOUBLE) / abs(CAST(b.value AS DOUBLE)), 6) END AS growth
    FROM m a LEFT JOIN m b ON b.company = a.company AND b.metric = a.metric AND b.period_no = a.period_no - 4""",
)
def f4(t: Inputs) -> DataFrame:
    rows = compare.growth_series(t.report_metrics, lag_periods=4)
    return rows.select("company", "metric", "fiscal_period", money("previous"), money("delta"), F.round("growth", 6).alias("growth"))


@query(
    "f5_compare_matrix",
    """WITH p AS (SELECT comparison_id, metric, slot, CAST(value AS DOUBLE) AS value FROM report_metrics m JOIN matrix_slots s ON s.document_id = m.document_id),
    r AS (SELECT *, CASE WHEN value IS NOT NULL THEN dense_rank() OVER (PARTITION BY comparison_id, metric ORDER BY value DESC NULLS LAST) END AS rank FROM p)
    SELECT comparison_id, metric, round(max(CASE WHEN slot = 1 THEN value END), 4) AS value_1, round(max(CASE WHEN slot = 2 THEN value END), 4) AS value_2,
      round(max(CASE WHEN slot = 3 THEN value END), 4) AS value_3, round(max(CASE WHEN slot = 4 THEN value END), 4) AS value_4,
      max(CASE WHEN slot = 1 THEN rank END) AS rank_1, max(CASE WHEN slot = 2 THEN rank END) AS rank_2, max(CASE WHEN slot = 3 THEN rank END) AS rank_3, max(CASE WHEN slot = 4 THEN rank END) AS rank_4
    FROM r GROUP BY comparison_id, metric""",
)
def f5(t: Inputs) -> DataFrame:
    slots = t.report_figures.selectExpr(
        "concat(company, '-', substr(fiscal_period, 1, 4)) as comparison_id", "cast(substr(fiscal_period, 6, 1) as int) as slot", "document_id"
    )
    rows = compare.compare_many(t.report_metrics, slots)
    return rows.select(
        "comparison_id", "metric", *[money(f"value_{s}") for s in range(1, 5)],
        *[F.col(f"rank_{s}").cast("bigint").alias(f"rank_{s}") for s in range(1, 5)],
    )


@query(
    "f6_margins",
    """SELECT document_id, company, fiscal_period, round(CAST(revenue - cost_of_revenue AS DOUBLE) / CAST(revenue AS DOUBLE), 6) AS gross_margin,
      round(CAST(revenue - cost_of_revenue - taxes AS DOUBLE) / CAST(revenue AS DOUBLE), 6) AS operating_margin, CAST(NULL AS DOUBLE) AS net_margin FROM report_figures""",
)
def f6(t: Inputs) -> DataFrame:
    rows = compare.margins(t.report_metrics)
    return rows.select(
        "document_id", "company", "fiscal_period", *[F.round(c, 6).alias(c) for c in ("gross_margin", "operating_margin", "net_margin")]
    )


@query(
    "f7_segment_mix",
    """SELECT a.company, a.fiscal_period, a.segment, round(a.share, 6) AS share, round(a.share - b.share, 6) + 0.0 AS share_change,
      CAST(m.value - a.total AS DOUBLE) + 0.0 AS unexplained
    FROM mix a LEFT JOIN mix b ON b.company = a.company AND b.segment = a.segment AND b.period_no = a.period_no - 1
    LEFT JOIN report_metrics m ON m.company = a.company AND m.fiscal_period = a.fiscal_period AND m.metric = 'revenue'""",
)
def f7(t: Inputs) -> DataFrame:
    segments = t.report_segments.select("company", "fiscal_period", "segment", "value")
    reported = t.report_metrics.filter("metric = 'revenue'").select("company", "fiscal_period", "value")
    rows = compare.segment_mix(segments, reported)
    return rows.select(
        "company", "fiscal_period", "segment", F.round("share", 6).alias("share"), (F.round("share_change", 6) + 0.0).alias("share_change"),
        (F.col("unexplained").cast("double") + 0.0).alias("unexplained"),
    )


@query(
    "f8_missing_metrics",
    """SELECT id, company FROM lib_documents WHERE id NOT IN (
      SELECT CAST(unnest([vec_id, vec_id * 2]) AS VARCHAR) FROM embeddings WHERE label % 3 = 0)""",
)
def f8(t: Inputs) -> DataFrame:
    stored = t.table("embeddings").selectExpr(
        "vec_id as id", "case when label % 3 = 0 then 'metrics' else 'insights' end as type",
        "array(cast(vec_id as string), cast(vec_id * 2 as string)) as document_ids",
    )
    return compare.missing_metrics(t.lib_documents.select("id", "company"), stored)


@query(
    "f9_comparison_result",
    f"""WITH s AS (SELECT 'risk' AS dimension, document_id, id, round(list_cosine_similarity(embedding, {SQL_A}), 6) + 0.0 AS score FROM vec_chunks
      UNION ALL SELECT 'guidance', document_id, id, round(list_cosine_similarity(embedding, {SQL_B}), 6) + 0.0 FROM vec_chunks),
    e AS (SELECT document_id, id, dimension, score FROM s QUALIFY row_number() OVER (PARTITION BY dimension, document_id ORDER BY score DESC, id) <= 2),
    b AS (SELECT p.*, r.document_id AS base_document_id FROM pairs p LEFT JOIN (SELECT *, {ORDINAL} AS no FROM report_figures) r ON r.company = p.company AND r.no = p.period_no - 1),
    d AS (SELECT document_id, string_agg(DISTINCT base_document_id, ',') AS base FROM b GROUP BY document_id)
    SELECT b.document_id AS comparison_id, array_to_string(list_sort(list_filter([b.document_id, d.base], lambda x: x IS NOT NULL)), ',') AS document_ids, 'table' AS part,
      metric AS name, b.base_document_id AS other_document, round(CAST(base_value AS DOUBLE), 4) AS base_value, round(CAST(other_value AS DOUBLE), 4) AS other_value, round(CAST(other_value - base_value AS DOUBLE), 4) AS number
    FROM b JOIN d ON d.document_id = b.document_id
    UNION ALL SELECT document_id, document_id, 'evidence', dimension, CAST(id AS VARCHAR), NULL, NULL, score FROM e""",
)
def f9(t: Inputs) -> DataFrame:
    deltas = compare.period_deltas(t.company_metrics, compare.quarter_ordinal(F.col("fiscal_period")), together=True).withColumn(
        "comparison_id", F.col("document_id")
    )
    evidence = search.retrieve_by_dimension({"risk": VECTOR_A, "guidance": VECTOR_B}, t.vec_chunks, None, 2).selectExpr(
        "document_id as comparison_id", "document_id", "id as chunk_id", "dimension", "score"
    )
    rows = compare.comparison_result(deltas, evidence, together=["company"])
    # The records are read back from their JSON, entry by entry.
    record = F.from_json(
        "result",
        "table array<struct<metric:string,base_document_id:string,base_value:decimal(28,4),other_value:decimal(28,4),delta:decimal(28,4)>>, "
        "evidence array<struct<chunk_id:string,dimension:string,score:double>>",
    )
    read = rows.select("comparison_id", F.array_join("document_ids", ",").alias("document_ids"), record.alias("r"))

    def entry(part: str, name: F.Column, other: F.Column, **numbers: F.Column) -> F.Column:
        values = [F.round(numbers[n].cast("double"), 4).alias(n) if n in numbers else F.lit(None).cast("double").alias(n) for n in ("base_value", "other_value")]
        return F.struct(F.lit(part).alias("part"), name.alias("name"), other.alias("other_document"), *values, numbers["number"].alias("number"))

    table = F.transform(
        "r.table",
        lambda e: entry("table", e["metric"], e["base_document_id"], base_value=e["base_value"], other_value=e["other_value"], number=F.round(e["delta"].cast("double"), 4)),
    )
    chunks = F.transform("r.evidence", lambda e: entry("evidence", e["dimension"], e["chunk_id"], number=e["score"]))
    # Both lists leave a record at once, so that records are put together once.
    both = F.flatten(F.array_compact(F.array(table, chunks)))
    return read.select("comparison_id", "document_ids", F.inline(both))


@query(
    "flow_compare_reports",
    f"""WITH v AS (SELECT document_id, company, metric, period_no,
        CAST(CAST(value * CASE unit WHEN 'units' THEN 1 ELSE 1000 END AS DECIMAL(18,4)) * CASE WHEN m.currency = 'USD' THEN CAST(1 AS DECIMAL(10,2)) ELSE CAST(r.rate AS DECIMAL(10,2)) END AS DECIMAL(28,4)) AS value
      FROM (SELECT *, {ORDINAL} AS period_no FROM report_metrics) m LEFT JOIN fx_rates r ON r.currency = m.currency AND r.fiscal_period = m.fiscal_period)
    SELECT o.document_id AS comparison_id, o.metric, b.document_id AS base_document_id, CAST(b.value AS DOUBLE) AS base_value, CAST(o.value AS DOUBLE) AS other_value,
      CAST(o.value - b.value AS DOUBLE) AS delta
    FROM v o LEFT JOIN v b ON b.company = o.company AND b.metric = o.metric AND b.period_no = o.period_no - 1""",
)
def flow_compare(t: Inputs) -> DataFrame:
    chunks = t.vec_chunks.select("id", "document_id", "user_id", "embedding")
    rows = compare_reports(t.company_metrics, t.fx_rates, chunks, {"risk": VECTOR_A}, compare.quarter_ordinal(F.col("fiscal_period")), together=True)
    record = F.from_json(
        "result", "table array<struct<metric:string,base_document_id:string,base_value:decimal(28,4),other_value:decimal(28,4),delta:decimal(28,4)>>"
    )
    entries = rows.select("comparison_id", F.explode(record["table"]).alias("e"))
    return entries.select(
        "comparison_id", "e.metric", "e.base_document_id",
        *[F.col(f"e.{c}").cast("double").alias(c) for c in ("base_value", "other_value", "delta")],
    )
