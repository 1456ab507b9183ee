"""Library tables derived from the driver tables, once for Spark and once as SQL views.

Both definitions must give the same rows; every row of the source tables takes part.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources import read_table

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

SQL_VIEWS: dict[str, str] = {}

# The library's documents: owner, company, type, period, status from the plain documents.
SQL_VIEWS["lib_documents"] = """
SELECT CAST(doc_id AS VARCHAR) AS id, 'u' || CAST(doc_id % 20 AS VARCHAR) AS user_id, source AS company,
  CASE doc_id % 5 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' WHEN 2 THEN 'annual' WHEN 3 THEN 'earnings' ELSE 'other' END AS report_type,
  'FY' || CAST(2020 + doc_id % 5 AS VARCHAR) AS fiscal_period,
  CASE WHEN n_chars < 300 THEN 'failed' WHEN n_chars < 800 THEN 'queued' WHEN n_chars < 1500 THEN 'processing' ELSE 'ready' END AS status,
  CAST(ceil(len(string_split(text, chr(10))) / 40.0) AS INTEGER) AS page_count,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id AS INTEGER)) AS created_at, text
FROM documents"""

# Vectors as chunks of documents; some carry no section or pages.
SQL_VIEWS["vec_chunks"] = """
SELECT vec_id AS id, 'd' || CAST(label AS VARCHAR) AS document_id, 'u' || CAST(label % 3 AS VARCHAR) AS user_id,
  'text ' || CAST(vec_id AS VARCHAR) AS text,
  CASE label % 4 WHEN 0 THEN 'MD&A' WHEN 1 THEN 'Risk Factors' WHEN 2 THEN 'Notes' END AS section,
  CASE WHEN label % 5 <> 0 THEN CAST(vec_id % 50 + 1 AS INTEGER) END AS page_start,
  CASE WHEN label % 5 <> 0 THEN CAST(vec_id % 50 + 1 + vec_id % 3 AS INTEGER) END AS page_end,
  'c' || CAST(label % 6 AS VARCHAR) AS company, 'FY' || CAST(2020 + label % 3 AS VARCHAR) AS fiscal_period,
  CAST(embedding AS DOUBLE[]) AS embedding
FROM embeddings"""

# Every vector also asks a question: over the whole library, over three documents, or over none.
SQL_VIEWS["vec_questions"] = """
SELECT vec_id AS qid, 'u' || CAST(label % 3 AS VARCHAR) AS user_id, CAST(embedding AS DOUBLE[]) AS embedding,
  CASE WHEN vec_id % 3 = 0 THEN NULL WHEN vec_id % 7 = 0 THEN []
    ELSE ['d' || CAST(label AS VARCHAR), 'd' || CAST(label + 3 AS VARCHAR), 'd' || CAST(label + 4 AS VARCHAR)] END AS document_ids
FROM embeddings"""

SQL_VIEWS["vec_scored"] = """
SELECT q.qid, c.id, c.document_id, c.text, c.section, c.page_start, c.page_end, c.company, c.fiscal_period,
  round(list_cosine_similarity(q.embedding, c.embedding), 6) + 0.0 AS score
FROM vec_questions q JOIN vec_chunks c ON q.user_id = c.user_id
WHERE q.document_ids IS NULL OR list_contains(q.document_ids, c.document_id)"""

SQL_VIEWS["vec_ranked"] = """
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM vec_scored"""

# One report per part and quarter in which it was shipped, so that quarters, segments and returns are
# missing wherever there were none. Suppliers are a report's segments.
SQL_VIEWS["report_figures"] = """
SELECT 'p' || CAST(l_partkey AS VARCHAR) || '-' || CAST(year(l_shipdate) AS VARCHAR) || 'Q' || CAST(quarter(l_shipdate) AS VARCHAR) AS document_id,
  'p' || CAST(l_partkey AS VARCHAR) AS company,
  CAST(year(l_shipdate) AS VARCHAR) || 'Q' || CAST(quarter(l_shipdate) AS VARCHAR) AS fiscal_period,
  CASE l_partkey % 2 WHEN 0 THEN 'units' ELSE 'thousands' END AS unit,
  CASE l_partkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'JPY' END AS currency,
  SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS revenue,
  SUM(CAST(l_extendedprice * (0.5 + l_tax) AS DECIMAL(18,4))) AS cost_of_revenue,
  SUM(CAST(l_extendedprice * l_tax AS DECIMAL(18,4))) AS taxes,
  SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,4)) END) AS returned,
  SUM(CASE WHEN l_returnflag IN ('R', 'A') THEN CAST(l_extendedprice AS DECIMAL(18,4)) END) AS returned_or_accepted,
  COUNT(CASE WHEN l_returnflag = 'R' THEN 1 END) AS return_lines, COUNT(*) AS lines, MIN(l_linenumber) AS first_line
FROM lineitem GROUP BY ALL"""

SQL_VIEWS["report_metrics"] = """
SELECT document_id, company, fiscal_period, metric, CAST(value AS DECIMAL(28,4)) AS value, unit, currency, CAST(first_line AS INTEGER) AS source_page
FROM (
  SELECT *, 'revenue' AS metric, revenue AS value FROM report_figures
  UNION ALL SELECT *, 'cost_of_revenue', cost_of_revenue FROM report_figures
  UNION ALL SELECT *, 'gross_income', revenue - cost_of_revenue FROM report_figures
  UNION ALL SELECT *, 'operating_income', revenue - cost_of_revenue - taxes FROM report_figures
  UNION ALL SELECT *, 'free_cash_flow', revenue - returned FROM report_figures)"""

SQL_VIEWS["report_segments"] = """
SELECT r.document_id, r.company, r.fiscal_period, 's' || CAST(l_suppkey AS VARCHAR) AS segment, r.unit, r.currency, CAST(r.first_line AS INTEGER) AS source_page,
  CAST(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS value
FROM lineitem l JOIN report_figures r ON r.company = 'p' || CAST(l.l_partkey AS VARCHAR)
  AND r.fiscal_period = CAST(year(l_shipdate) AS VARCHAR) || 'Q' || CAST(quarter(l_shipdate) AS VARCHAR)
GROUP BY ALL"""

# Currency rates from order volumes; the last quarters ship orders but take none, so they have no rates.
SQL_VIEWS["fx_rates"] = """
SELECT currency, fiscal_period, CAST(1 + n % 97 / 100.0 AS DECIMAL(18,8)) AS rate
FROM (SELECT CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS fiscal_period, COUNT(*) AS n FROM orders GROUP BY 1),
  (SELECT unnest(['EUR', 'JPY']) AS currency)"""

# The usage ledger, the request log, the stage log and the call log, all from the event stream.
SQL_VIEWS["usage_log"] = """
SELECT event_id AS id, 'u' || CAST(user_id AS VARCHAR) AS user_id,
  CASE WHEN event_type IN ('view', 'click') THEN 'embedding' ELSE 'llm' END AS kind,
  CASE WHEN event_type IN ('view', 'purchase') THEN 'acme' ELSE 'globex' END AS provider, event_type AS model,
  CAST(round(value * 100) AS BIGINT) AS tokens_in,
  CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE CAST(round(value * 100) AS BIGINT) % 97 END AS tokens_out,
  CAST(CAST(round(value * 100) AS BIGINT) AS DECIMAL(12,0)) * CAST('0.000002' AS DECIMAL(10,6)) AS cost_estimate, ts AS created_at
FROM events"""

SQL_VIEWS["request_log"] = """
SELECT event_id, ts, '10.0.0.' || CAST(user_id % 10 AS VARCHAR) AS ip,
  CASE WHEN event_type = 'signup' THEN '/api/v1/auth/login' ELSE '/api/v1/documents' END AS path,
  CASE WHEN event_type <> 'error' THEN 'u' || CAST(user_id AS VARCHAR) END AS user_id
FROM events"""

SQL_VIEWS["stage_log"] = """
SELECT event_id, 'd' || CAST(user_id AS VARCHAR) AS document_id, ts,
  CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 WHEN 0 THEN 'store' WHEN 1 THEN 'metadata' WHEN 2 THEN 'parse_chunk' WHEN 3 THEN 'embed_index' ELSE 'analyze' END AS stage,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'ready' WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' ELSE 'completed' END AS status,
  CASE WHEN event_type = 'error' THEN 'error ' || CAST(event_id AS VARCHAR) END AS error,
  1 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS attempt
FROM events"""

SQL_VIEWS["call_log"] = """
SELECT event_id // 4 AS request_id, CAST(event_id % 4 AS INTEGER) AS attempt,
  CASE event_type WHEN 'error' THEN 429 WHEN 'click' THEN 503 WHEN 'signup' THEN 400 ELSE 200 END AS status_code,
  CASE WHEN event_type = 'view' AND value > 20 THEN 'SAFETY' ELSE 'STOP' END AS finish_reason,
  NOT (event_type = 'purchase' AND value > 20) AS valid,
  CASE WHEN value > 30 THEN round(value, 2) ELSE 0.0 END AS retry_after, event_id
FROM events"""

# Answers with markers after every assistant or user text, and the blocks each was given.
SQL_VIEWS["marked_answers"] = """
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS qid,
  CASE WHEN turn % 5 = 4 THEN text ELSE text || ' [' || CAST(conv_id % 9 AS VARCHAR) || '] so [' || CAST((conv_id + turn * 3) % 11 AS VARCHAR) || '][' || CAST(turn + 1 AS VARCHAR) || '] end [' || CAST(conv_id % 9 AS VARCHAR) || ']. [99999999999]' END AS text, conv_id, turn
FROM conversations"""

SQL_VIEWS["given_blocks"] = """
SELECT qid, CAST(n AS INTEGER) AS n, qid || '/' || CAST(n AS VARCHAR) AS chunk_id, 'd' || CAST(conv_id AS VARCHAR) AS document_id,
  CAST(n * 2 AS INTEGER) AS page_start, CAST(n * 2 + 1 AS INTEGER) AS page_end
FROM (SELECT *, unnest(generate_series(1, 1 + turn % 8)) AS n FROM marked_answers)"""


class Inputs:
    """The driver tables of one folder and what is derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name, SCHEMAS[name], spread=name in ("documents", "embeddings"))

    @cached_property
    def lib_documents(self) -> DataFrame:
        return self.as_library(self.table("documents"))

    @staticmethod
    def as_library(documents: DataFrame) -> DataFrame:
        return documents.selectExpr(
            "cast(doc_id as string) as id",
            "concat('u', doc_id % 20) as user_id",
            "source as company",
            "case doc_id % 5 when 0 then '10-K' when 1 then '10-Q' when 2 then 'annual' when 3 then 'earnings' else 'other' end as report_type",
            "concat('FY', 2020 + doc_id % 5) as fiscal_period",
            "case when n_chars < 300 then 'failed' when n_chars < 800 then 'queued' when n_chars < 1500 then 'processing' else 'ready' end as status",
            "cast(ceil(size(split(text, '\\n')) / 40.0) as int) as page_count",
            "timestamp_seconds(1704067200 + doc_id * 3600) as created_at",
            "text",
        )

    @cached_property
    def vec_chunks(self) -> DataFrame:
        return self.table("embeddings").selectExpr(
            "vec_id as id",
            "concat('d', label) as document_id",
            "concat('u', label % 3) as user_id",
            "concat('text ', vec_id) as text",
            "case label % 4 when 0 then 'MD&A' when 1 then 'Risk Factors' when 2 then 'Notes' end as section",
            "case when label % 5 <> 0 then cast(vec_id % 50 + 1 as int) end as page_start",
            "case when label % 5 <> 0 then cast(vec_id % 50 + 1 + vec_id % 3 as int) end as page_end",
            "concat('c', label % 6) as company",
            "concat('FY', 2020 + label % 3) as fiscal_period",
            "embedding",
        )

    @cached_property
    def vec_questions(self) -> DataFrame:
        return self.table("embeddings").selectExpr(
            "vec_id as qid",
            "concat('u', label % 3) as user_id",
            "embedding",
            "case when vec_id % 3 = 0 then null when vec_id % 7 = 0 then cast(array() as array<string>) "
            "else array(concat('d', label), concat('d', label + 3), concat('d', label + 4)) end as document_ids",
        )

    # Order lines that a task makes reports of; a report is many times as long as its lines.
    LINES_OF_A_TASK = 100_000

    # A report's company and period from its order lines.
    REPORT = ("concat('p', l_partkey) as company", "concat(year(l_shipdate), 'Q', quarter(l_shipdate)) as fiscal_period")

    @cached_property
    def report_figures(self) -> DataFrame:
        # Grouped by the names that reports are joined by, so that joins and groups by them find the rows where they are.
        return self._reports(self.table("lineitem").selectExpr("*", *self.REPORT))

    # Amounts have four decimals; they are added as whole ten-thousandths.
    AMOUNTS = {
        "revenue": "l_extendedprice * (1 - l_discount)",
        "cost": "l_extendedprice * (0.5D + l_tax)",
        "tax": "l_extendedprice * l_tax",
        "ret": "l_extendedprice",
        "ret_or_accepted": "l_extendedprice",
    }
    ONLY_IF = {"ret": "l_returnflag = 'R'", "ret_or_accepted": "l_returnflag in ('R', 'A')"}

    @classmethod
    def _amounts(cls) -> list[str]:
        whole = {name: f"cast(round(({expr}) * 10000) as bigint)" for name, expr in cls.AMOUNTS.items()}
        return [f"case when {cls.ONLY_IF[n]} then {w} end as {n}" if n in cls.ONLY_IF else f"{w} as {n}" for n, w in whole.items()]

    def _reports(self, lines: DataFrame) -> DataFrame:
        """Reports of the order lines, which have a report's company and period and the columns they are made of."""
        grouped = lines.selectExpr("company", "fiscal_period", "l_partkey", "l_linenumber", *self._amounts()).groupBy("company", "fiscal_period").agg(
            F.min("l_partkey").alias("l_partkey"),
            F.sum("revenue").alias("revenue"),
            F.sum("cost").alias("cost_of_revenue"),
            F.sum("tax").alias("taxes"),
            F.sum("ret").alias("returned"),
            F.sum("ret_or_accepted").alias("returned_or_accepted"),
            F.count("ret").alias("return_lines"),
            F.count(F.lit(1)).alias("lines"),
            F.min("l_linenumber").alias("first_line"),
        )
        return self._named(grouped)

    @staticmethod
    def _named(grouped: DataFrame, *more: str) -> DataFrame:
        amounts = ("revenue", "cost_of_revenue", "taxes", "returned", "returned_or_accepted")
        return grouped.selectExpr(
            "concat(company, '-', fiscal_period) as document_id",
            "company",
            "fiscal_period",
            "case l_partkey % 2 when 0 then 'units' else 'thousands' end as unit",
            "case l_partkey % 3 when 0 then 'USD' when 1 then 'EUR' else 'JPY' end as currency",
            *[f"cast({a} * 0.0001BD as decimal(28,4)) as {a}" for a in amounts],
            "return_lines",
            "lines",
            "first_line",
            *more,
        )

    @cached_property
    def report_metrics(self) -> DataFrame:
        return self._metrics(self.report_figures)

    @cached_property
    def company_lines(self) -> DataFrame:
        """Order lines with their report's company and period, those of a company in one place.

        Only stored columns travel, as they are shorter than what is made of them, and to as many tasks as keep the lines
        of each few, so that what is made of them there is grouped and sorted in memory.
        """
        lineitem = self.table("lineitem")
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-lineitem.count() // self.LINES_OF_A_TASK))
        kept = ("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
        company, period = (F.expr(r) for r in (self.REPORT[0].removesuffix(" as company"), self.REPORT[1]))
        return lineitem.select(*kept, period).repartition(tasks, company).select("*", company.alias("company"))

    @cached_property
    def company_figures(self) -> DataFrame:
        """The rows of ``report_figures``, those of a company in one place."""
        return self._reports(self.company_lines)

    @cached_property
    def company_metrics(self) -> DataFrame:
        """The rows of ``report_metrics``, those of a company in one place."""
        return self._metrics(self.company_figures)

    @cached_property
    def company_all_metrics(self) -> DataFrame:
        """The rows of ``report_metrics`` (segment null) and of ``report_segments`` (``segment_revenue``), those of a company in one place.

        A report's segments are summed first and its figures from these, so that lines travel once for both.
        """
        lines = self.company_lines.selectExpr("company", "fiscal_period", "l_suppkey", "l_partkey", "l_linenumber", *self._amounts())
        by_segment = lines.groupBy("company", "fiscal_period", "l_suppkey").agg(
            F.min("l_partkey").alias("l_partkey"), F.min("l_linenumber").alias("first_line"), *[F.sum(a).alias(a) for a in self.AMOUNTS],
            F.count("ret").alias("return_lines"), F.count(F.lit(1)).alias("lines"),
        )
        grouped = by_segment.groupBy("company", "fiscal_period").agg(
            F.min("l_partkey").alias("l_partkey"), F.min("first_line").alias("first_line"),
            *[F.sum(a).alias(name) for a, name in zip(self.AMOUNTS, ("revenue", "cost_of_revenue", "taxes", "returned", "returned_or_accepted"))],
            F.sum("return_lines").alias("return_lines"), F.sum("lines").alias("lines"),
            F.collect_list(F.struct("l_suppkey", F.col("revenue").alias("amount"))).alias("segments"),
        )
        figure = "named_struct('metric', '{}', 'segment', cast(null as string), 'value', cast({} as decimal(28,4)))"
        figures = ", ".join(figure.format(name, value) for name, value in self.METRICS.items())
        # A report without a company or period has no segments.
        segments = (
            "transform(if(company is null or fiscal_period is null, slice(segments, 1, 0), segments), s -> named_struct("
            "'metric', 'segment_revenue', 'segment', concat('s', s.l_suppkey), 'value', cast(s.amount * 0.0001BD as decimal(28,4))))"
        )
        return self._named(grouped, "segments").selectExpr(
            "document_id", "company", "fiscal_period", "unit", "currency", "cast(first_line as int) as source_page", f"inline(concat(array({figures}), {segments}))"
        ).select("document_id", "company", "fiscal_period", "metric", "segment", "value", "unit", "currency", "source_page")

    METRICS = {
        "revenue": "revenue",
        "cost_of_revenue": "cost_of_revenue",
        "gross_income": "revenue - cost_of_revenue",
        "operating_income": "revenue - cost_of_revenue - taxes",
        "free_cash_flow": "revenue - returned",
    }

    @classmethod
    def _metrics(cls, figures: DataFrame) -> DataFrame:
        return figures.selectExpr(
            "document_id",
            "company",
            "fiscal_period",
            "unit",
            "currency",
            "cast(first_line as int) as source_page",
            f"stack({len(cls.METRICS)}, {', '.join(f"'{name}', cast({value} as decimal(28,4))" for name, value in cls.METRICS.items())}) as (metric, value)",
        ).select("document_id", "company", "fiscal_period", "metric", "value", "unit", "currency", "source_page")

    @cached_property
    def report_segments(self) -> DataFrame:
        sums = (
            self.table("lineitem")
            .selectExpr(
                *self.REPORT, "l_suppkey", "cast(round(l_extendedprice * (1 - l_discount) * 10000) as bigint) as amount"
            )
            .groupBy("company", "fiscal_period", "l_suppkey")
            .agg(F.sum("amount").alias("amount"))
            .selectExpr(
                "company", "fiscal_period", "concat('s', l_suppkey) as segment", "cast(amount * 0.0001BD as decimal(28,4)) as value"
            )
        )
        reports = self.report_figures.selectExpr(
            "document_id", "company", "fiscal_period", "unit", "currency", "cast(first_line as int) as source_page"
        )
        return sums.join(reports, ["company", "fiscal_period"])

    @cached_property
    def fx_rates(self) -> DataFrame:
        n = (
            self.table("orders")
            .groupBy(F.expr("concat(year(o_orderdate), 'Q', quarter(o_orderdate))").alias("fiscal_period"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        rates = n.withColumn("currency", F.explode(F.array(F.lit("EUR"), F.lit("JPY"))))
        return rates.selectExpr(
            "currency", "fiscal_period", "cast(1 + n % 97 / 100.0 as decimal(18,8)) as rate"
        )

    @cached_property
    def usage_log(self) -> DataFrame:
        return self.as_usage(self.table("events"))

    @staticmethod
    def as_usage(events: DataFrame, *keep: str) -> DataFrame:
        return events.selectExpr(
            *keep,
            "event_id as id",
            "concat('u', user_id) as user_id",
            "case when event_type in ('view', 'click') then 'embedding' else 'llm' end as kind",
            "case when event_type in ('view', 'purchase') then 'acme' else 'globex' end as provider",
            "event_type as model",
            "cast(round(value * 100) as bigint) as tokens_in",
            "case when event_type in ('view', 'click') then 0 else cast(round(value * 100) as bigint) % 97 end as tokens_out",
            "cast(cast(cast(round(value * 100) as bigint) as decimal(12,0)) * 0.000002BD as decimal(18,6)) as cost_estimate",
            "ts as created_at",
        )

    @cached_property
    def request_log(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id",
            "ts",
            "concat('10.0.0.', user_id % 10) as ip",
            "case when event_type = 'signup' then '/api/v1/auth/login' else '/api/v1/documents' end as path",
            "case when event_type <> 'error' then concat('u', user_id) end as user_id",
        )

    @cached_property
    def stage_log(self) -> DataFrame:
        return self.as_stages(self.table("events"))

    @staticmethod
    def as_stages(events: DataFrame, *keep: str) -> DataFrame:
        k = "cast(get_json_object(props, '$.k') as int)"
        return events.selectExpr(
            *keep,
            "event_id",
            "concat('d', user_id) as document_id",
            "ts",
            f"case {k} % 5 when 0 then 'store' when 1 then 'metadata' when 2 then 'parse_chunk' when 3 then 'embed_index' else 'analyze' end as stage",
            "case event_type when 'error' then 'failed' when 'purchase' then 'ready' when 'signup' then 'queued' "
            "when 'view' then 'processing' else 'completed' end as status",
            "case when event_type = 'error' then concat('error ', event_id) end as error",
            f"1 + {k} % 4 as attempt",
        )

    @cached_property
    def call_log(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id div 4 as request_id",
            "cast(event_id % 4 as int) as attempt",
            "case event_type when 'error' then 429 when 'click' then 503 when 'signup' then 400 else 200 end as status_code",
            "case when event_type = 'view' and value > 20 then 'SAFETY' else 'STOP' end as finish_reason",
            "not (event_type = 'purchase' and value > 20) as valid",
            "case when value > 30 then round(value, 2) else 0D end as retry_after",
            "event_id",
        )

    @cached_property
    def marked_answers(self) -> DataFrame:
        return self.table("conversations").selectExpr(
            "concat(conv_id, '-', turn) as qid",
            "case when turn % 5 = 4 then text else concat(text, ' [', conv_id % 9, '] so [', (conv_id + turn * 3) % 11, '][', turn + 1, "
            "'] end [', conv_id % 9, ']. [99999999999]') end as text",
            "conv_id",
            "turn",
        )

    @cached_property
    def given_blocks(self) -> DataFrame:
        return (
            self.marked_answers.withColumn("n", F.explode(F.expr("sequence(1, cast(1 + turn % 8 as int))")))
            .selectExpr(
                "qid", "n", "concat(qid, '/', n) as chunk_id", "concat('d', conv_id) as document_id",
                "n * 2 as page_start", "n * 2 + 1 as page_end",
            )
        )
