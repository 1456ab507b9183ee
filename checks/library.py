"""Sources, table maintenance, listings and checks of library rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.inputs import Inputs
from checks.registry import query
from ledgerloom.operators import access, maintenance
from ledgerloom.operators.models import hash_embed
from ledgerloom.session import shared_dir
from ledgerloom.sources import buckets, index, objects


@query(
    "a1_read_table",
    """SELECT event_type, COUNT(*) AS n, epoch_us(MIN(ts)) AS first_us, epoch_us(MAX(ts)) AS last_us,
       COUNT(DISTINCT user_id) AS users FROM events GROUP BY event_type""",
)
def a1(t: Inputs) -> DataFrame:
    return t.table("events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.unix_micros(F.min("ts")).alias("first_us"),
        F.unix_micros(F.max("ts")).alias("last_us"),
        F.countDistinct("user_id").alias("users"),
    )


# Every document is stored as an object of its own, which ends in a line break, and read back.
@query(
    "a2_scan_objects",
    """SELECT source AS user_id, CAST(doc_id AS VARCHAR) AS document_id, strlen(text) + 1 AS size, strlen(text) + 1 > 3000 AS too_big,
      CASE WHEN strlen(text) + 1 <= 3000 THEN sha256(text || chr(10)) END AS content_sha256 FROM documents""",
)
def a2(t: Inputs) -> DataFrame:
    root = shared_dir(t.spark, "objects")
    stored = t.table("documents").select(F.col("source").alias("user"), F.col("doc_id").alias("document"), "text")
    objects.store_objects(stored, root)
    found = objects.scan_objects(t.spark, root, "*.txt", with_content=True, max_bytes=3000)
    user, document = (F.regexp_extract("path", objects.STORED_PATTERN, n) for n in (1, 2))
    return found.select(
        user.alias("user_id"), document.alias("document_id"), "size", F.col("content").isNull().alias("too_big"), F.sha2("content", 256).alias("content_sha256")
    )


# Every document stands for an uploaded object; some keys leave their root, some bytes are no PDF.
@query(
    "a3_validate_uploads",
    """SELECT key, size, bad_key, bad_magic, too_big, too_many_pages,
      NOT (bad_key OR bad_magic OR too_big OR too_many_pages) AS ok
    FROM (SELECT CASE WHEN doc_id % 11 = 0 THEN '../' || CAST(doc_id AS VARCHAR) || '.pdf' WHEN doc_id % 13 = 0 THEN CAST(doc_id AS VARCHAR) || '.pdf'
           ELSE 'u' || CAST(doc_id % 20 AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) || '.pdf' END AS key,
        n_chars * 8192 AS size, doc_id % 11 = 0 OR doc_id % 13 = 0 AS bad_key, NOT starts_with(text, 'The') AS bad_magic,
        n_chars * 8192 > 31457280 AS too_big, len(string_split(text, chr(10))) > 60 AS too_many_pages FROM documents)""",
)
def a3(t: Inputs) -> DataFrame:
    docs = t.table("documents").selectExpr(
        "case when doc_id % 11 = 0 then concat('../', doc_id, '.pdf') when doc_id % 13 = 0 then concat(doc_id, '.pdf') "
        "else concat('u', doc_id % 20, '/', doc_id, '.pdf') end as key",
        "n_chars * 8192 as size",
        "cast(text as binary) as content",
        "size(split(text, '\\n')) as page_count",
    )
    checked = objects.validate_uploads(
        docs.select("key", "size", "content"), b"The", 30, docs.select("key", "page_count"), max_pages=60
    )
    flags = [
        F.array_contains("reasons", r).alias(r) for r in ("bad_key", "bad_magic", "too_big", "too_many_pages")
    ]
    return checked.select("key", "size", *flags, "ok")


# Every order line is an update of its order; the dearest line wins.
UPSERTED = """WITH newest AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey DESC, l_suppkey DESC) = 1)
    SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT l_orderkey, l_linestatus, l_extendedprice FROM newest"""


@query("a4_upsert", UPSERTED)
def a4(t: Inputs) -> DataFrame:
    target = t.table("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    updates = t.table("lineitem").selectExpr(
        "l_orderkey as o_orderkey", "l_linestatus as o_orderstatus", "l_extendedprice as o_totalprice", "l_partkey", "l_suppkey"
    )
    return maintenance.upsert(target, updates, "o_orderkey", ["o_totalprice", "l_partkey", "l_suppkey"])


@query("a4_upsert_buckets", UPSERTED)
def a4_buckets(t: Inputs) -> DataFrame:
    target = t.table("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    updates = t.table("lineitem").selectExpr(
        "l_orderkey as o_orderkey", "l_linestatus as o_orderstatus", "l_extendedprice as o_totalprice", "l_partkey", "l_suppkey"
    )
    table = buckets.create_buckets(target, shared_dir(t.spark, "orders"), "o_orderkey", 16)
    return buckets.upsert_buckets(table, updates, ["o_totalprice", "l_partkey", "l_suppkey"]).read()


LEFT_OVER = """SELECT id, user_id, company, status FROM lib_documents
    WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1 OR quality = 0)"""


@query("a5_delete_buckets", LEFT_OVER)
def a5_buckets(t: Inputs) -> DataFrame:
    gone = t.table("labels").filter("toxic = 1 or quality = 0").selectExpr("cast(doc_id as string)")
    docs = t.lib_documents.select("id", "user_id", "company", "status")
    table = buckets.create_buckets(docs, shared_dir(t.spark, "library"), "id", 16)
    return buckets.delete_buckets(table, gone).read()


@query("a5_delete_by_document", LEFT_OVER)
def a5(t: Inputs) -> DataFrame:
    gone = t.table("labels").filter("toxic = 1 or quality = 0").selectExpr("cast(doc_id as string)")
    docs = t.lib_documents.select("id", "user_id", "company", "status")
    return maintenance.delete_by_document(docs, gone, "id")


# Users with a toxic document lose everything; documents of low quality go on their own.
@query(
    "a6_cascade_delete",
    """WITH gone_users AS (SELECT DISTINCT 'u' || CAST(doc_id % 20 AS VARCHAR) AS id FROM labels WHERE toxic = 1),
    gone_docs AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM labels WHERE quality = 0
      UNION SELECT id FROM lib_documents WHERE user_id IN (SELECT id FROM gone_users)),
    analyses AS (SELECT vec_id, 'u' || CAST(label % 25 AS VARCHAR) AS user_id,
      CASE WHEN vec_id % 4 = 0 THEN [] ELSE [CAST(vec_id AS VARCHAR), CAST(vec_id * 3 % 400 AS VARCHAR)] END AS document_ids FROM embeddings),
    talks AS (SELECT DISTINCT conv_id, 'u' || CAST(conv_id % 25 AS VARCHAR) AS user_id FROM conversations)
    SELECT 'documents' AS tab, COUNT(*) AS n FROM lib_documents WHERE id NOT IN (SELECT id FROM gone_docs)
    UNION ALL SELECT 'analyses', COUNT(*) FROM analyses WHERE user_id NOT IN (SELECT id FROM gone_users)
      AND (len(document_ids) = 0 OR vec_id IN (SELECT vec_id FROM (SELECT vec_id, unnest(document_ids) AS d FROM analyses) WHERE d NOT IN (SELECT id FROM gone_docs)))
    UNION ALL SELECT 'conversations', COUNT(*) FROM talks WHERE user_id NOT IN (SELECT id FROM gone_users)
    UNION ALL SELECT 'messages', COUNT(*) FROM conversations WHERE 'u' || CAST(conv_id % 25 AS VARCHAR) NOT IN (SELECT id FROM gone_users)
    UNION ALL SELECT 'usage', COUNT(*) FROM usage_log WHERE user_id NOT IN (SELECT id FROM gone_users)
    UNION ALL SELECT 'chunks', COUNT(*) FROM embeddings WHERE CAST(vec_id AS VARCHAR) NOT IN (SELECT id FROM gone_docs)""",
)
def a6(t: Inputs) -> DataFrame:
    labels = t.table("labels")
    talk = t.table("conversations").selectExpr("conv_id", "concat('u', conv_id % 25) as user_id")
    tables = {
        "documents": t.lib_documents.select("id", "user_id"),
        "analyses": t.table("embeddings").selectExpr(
            "vec_id as id", "concat('u', label % 25) as user_id",
            "case when vec_id % 4 = 0 then cast(array() as array<string>) "
            "else array(cast(vec_id as string), cast(vec_id * 3 % 400 as string)) end as document_ids",
        ),
        "conversations": talk.selectExpr("conv_id as id", "user_id").distinct(),
        "messages": t.table("conversations").selectExpr("conv_id as conversation_id", "turn"),
        "usage": t.usage_log.select("id", "user_id"),
        "chunks": t.table("embeddings").selectExpr("vec_id as id", "cast(vec_id as string) as document_id"),
    }
    left = maintenance.cascade_delete(
        tables,
        users=labels.filter("toxic = 1").selectExpr("concat('u', doc_id % 20)"),
        documents=labels.filter("quality = 0").selectExpr("cast(doc_id as string)"),
    )
    counts = [df.agg(F.lit(name).alias("tab"), F.count(F.lit(1)).alias("n")) for name, df in left.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query(
    "a7_reindex",
    """SELECT id, len(text) AS chars, 16 AS size, 2 AS version FROM lib_documents""",
)
def a7(t: Inputs) -> DataFrame:
    out = shared_dir(t.spark, "reindex")
    docs = t.lib_documents.select("id", "text")
    for version, dim in ((1, 8), (2, 16)):
        index.reindex(docs, lambda df, d=dim: hash_embed(df, dim=d), out, version, "fake", "fake-embedding", dim)
    newest = index.read_index_meta(t.spark, out).agg(F.max("id")).first()[0]
    return index.read_published(t.spark, out).select(
        "id", F.length("text").alias("chars"), F.size("embedding").alias("size"), F.lit(newest).cast("int").alias("version")
    )


@query(
    "a8_find_orphans",
    """SELECT 'document_without_object' AS issue, CAST(doc_id AS BIGINT) AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'object_without_document', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT 'chunk_without_document', vec_id FROM embeddings WHERE vec_id * 3 NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT 'vector_without_chunk', event_id FROM events WHERE event_id NOT IN (SELECT vec_id FROM embeddings)""",
)
def a8(t: Inputs) -> DataFrame:
    return maintenance.find_orphans(
        t.table("documents").selectExpr("doc_id as id"),
        t.table("labels").selectExpr("doc_id as document_id"),
        t.table("embeddings").selectExpr("vec_id as id", "vec_id * 3 as document_id"),
        t.table("events").selectExpr("event_id as id"),
    )


@query("b1_scope_to_user", "SELECT id, company, status FROM lib_documents WHERE user_id = 'u7'")
def b1(t: Inputs) -> DataFrame:
    return access.scope_to_user(t.lib_documents, "u7").select("id", "company", "status")


@query(
    "b2_apply_filters",
    """SELECT id, document_id, user_id FROM vec_chunks WHERE user_id = 'u1' AND document_id IN ('d1', 'd4', 'd7', 'd22') AND fiscal_period IN ('FY2021', 'FY2022')""",
)
def b2(t: Inputs) -> DataFrame:
    filters = {
        "user_id": "u1", "document_ids": ["d1", "d4", "d7", "d22"], "fiscal_period": ("FY2021", "FY2022"), "company": None,
    }
    return access.apply_filters(t.vec_chunks, filters).select("id", "document_id", "user_id")


@query("b2_empty_filter", "SELECT 'kept' AS what, 0 AS n UNION ALL SELECT 'chunks', COUNT(*) FROM vec_chunks")
def b2_empty(t: Inputs) -> DataFrame:
    kept = access.apply_filters(t.vec_chunks, {"document_ids": []})
    return kept.agg(F.lit("kept").alias("what"), F.count(F.lit(1)).alias("n")).unionByName(
        t.vec_chunks.agg(F.lit("chunks").alias("what"), F.count(F.lit(1)).alias("n"))
    )


@query(
    "b3_normalize_hits",
    """SELECT id, section, page_start, page_end, company FROM (
      SELECT id, section, page_start, page_end, CASE WHEN id % 6 = 0 THEN NULL ELSE company END AS company FROM vec_chunks)""",
)
def b3(t: Inputs) -> DataFrame:
    outside = t.vec_chunks.select(
        "id",
        F.coalesce("section", F.lit("")).alias("section"),
        F.coalesce("page_start", F.lit(-1)).alias("page_start"),
        F.coalesce("page_end", F.lit(-1)).alias("page_end"),
        F.when(F.col("id") % 6 == 0, "").otherwise(F.col("company")).alias("company"),
    )
    return access.normalize_hits(outside)


@query(
    "b4_duplicate_accounts",
    """SELECT lower(trim(email)) AS email_key, COUNT(*) AS accounts, min(struct_pack(at := c_acctbal, id := c_custkey)).id AS first_id FROM (
      SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 2 = 0 THEN '  ' || c_mktsegment || CAST(c_custkey % 700 AS VARCHAR) || '@Example.com ' ELSE lower(c_mktsegment) || CAST(c_custkey % 700 AS VARCHAR) || '@example.COM' END AS email FROM customer)
    GROUP BY 1 HAVING COUNT(*) > 1""",
)
def b4(t: Inputs) -> DataFrame:
    users = t.table("customer").selectExpr(
        "c_custkey as id",
        "case when c_custkey % 2 = 0 then concat('  ', c_mktsegment, c_custkey % 700, '@Example.com ') "
        "else concat(lower(c_mktsegment), c_custkey % 700, '@example.COM') end as email",
        "c_acctbal as created_at",
    )
    return access.duplicate_accounts(users).select("email_key", "accounts", "first_id")


@query(
    "b5_list_library",
    """SELECT id, status, epoch_us(created_at) AS created_us FROM lib_documents WHERE user_id = 'u3' AND status = 'ready'
      AND created_at < TIMESTAMP '2024-02-01' ORDER BY created_at DESC, id LIMIT 10""",
)
def b5(t: Inputs) -> DataFrame:
    after = (F.lit("2024-02-01").cast("timestamp"), "~")
    page = access.list_library(t.lib_documents, "u3", 10, after, "ready")
    return page.select("id", "status", F.unix_micros("created_at").alias("created_us"))


@query(
    "b6_library_overview",
    """WITH analyses AS (SELECT vec_id AS id, CASE label % 3 WHEN 0 THEN 'metrics' WHEN 1 THEN 'insights' ELSE 'comparison' END AS type,
        [CAST(vec_id AS VARCHAR), CAST(vec_id + 20 AS VARCHAR)] AS document_ids FROM embeddings),
    done AS (SELECT DISTINCT d.user_id, a.id, a.type FROM (SELECT id, type, unnest(document_ids) AS document_id FROM analyses) a JOIN lib_documents d ON d.id = a.document_id)
    SELECT d.*, COALESCE(m, 0) AS metrics_analyses, COALESCE(i, 0) AS insights_analyses, COALESCE(c, 0) AS comparison_analyses FROM
      (SELECT user_id, COUNT(*) AS documents, count_if(status = 'queued') AS queued, count_if(status = 'processing') AS processing,
        count_if(status = 'ready') AS ready, count_if(status = 'failed') AS failed, epoch_us(MAX(created_at)) AS newest_us FROM lib_documents GROUP BY user_id) d
      LEFT JOIN (SELECT user_id, count_if(type = 'metrics') AS m, count_if(type = 'insights') AS i, count_if(type = 'comparison') AS c FROM done GROUP BY user_id) a
      ON a.user_id = d.user_id""",
)
def b6(t: Inputs) -> DataFrame:
    analyses = t.table("embeddings").selectExpr(
        "vec_id as id",
        "case label % 3 when 0 then 'metrics' when 1 then 'insights' else 'comparison' end as type",
        "array(cast(vec_id as string), cast(vec_id + 20 as string)) as document_ids",
    )
    overview = access.library_overview(t.lib_documents, analyses)
    return overview.withColumn("newest_us", F.unix_micros("newest_at")).drop("newest_at")


@query(
    "b7_validate_metrics",
    """WITH m AS (SELECT document_id, metric, value, CASE WHEN source_page > 1 THEN source_page - 1 END AS source_page FROM report_metrics),
    d AS (SELECT document_id, return_lines AS page_count FROM report_figures WHERE return_lines > 0)
    SELECT m.document_id, m.metric, CASE WHEN d.page_count IS NULL THEN 'unknown_document' WHEN m.source_page IS NULL THEN 'missing_page' ELSE 'page_out_of_range' END AS reason
    FROM m LEFT JOIN d ON d.document_id = m.document_id
    WHERE m.value IS NOT NULL AND (d.page_count IS NULL OR m.source_page IS NULL OR m.source_page < 1 OR m.source_page > d.page_count)""",
)
def b7(t: Inputs) -> DataFrame:
    # The library holds the reports of parts that came back, with a page per returned line.
    metrics = t.report_metrics.withColumn(
        "source_page", F.when(F.col("source_page") > 1, F.col("source_page") - 1)
    )
    documents = t.report_figures.filter("return_lines > 0").selectExpr("document_id as id", "return_lines as page_count")
    return access.validate_metrics(metrics, documents).select("document_id", "metric", "reason")


# Model output of every kind: right, null, wrong type, broken, missing field.
@query(
    "b8_parse_structured",
    """SELECT event_id, CASE WHEN event_id % 6 IN (2, 3, 4) THEN 'invalid_response' ELSE 'ok' END AS outcome,
      CASE WHEN event_id % 6 IN (0, 5) THEN value END AS revenue,
      CASE WHEN event_id % 6 NOT IN (2, 3, 4) THEN event_type END AS company,
      CASE WHEN event_id % 6 IN (0, 1) THEN CAST(user_id AS INTEGER) END AS source_page FROM events""",
)
def b8(t: Inputs) -> DataFrame:
    out = t.table("events").selectExpr(
        "event_id",
        """case event_id % 6
          when 0 then concat('{"revenue":', value, ',"company":"', event_type, '","source_page":', user_id, '}')
          when 1 then concat('{"revenue":null,"company":"', event_type, '","source_page":', user_id, '}')
          when 2 then concat('{"revenue":"many","company":"', event_type, '"}')
          when 3 then concat('{"revenue":', value)
          when 4 then concat('{"revenue":', value, '}')
          else concat('{"revenue":', value, ',"company":"', event_type, '"}') end as response""",
    )
    schema = T.StructType(
        [
            T.StructField("revenue", T.DoubleType(), True),
            T.StructField("company", T.StringType(), False),
            T.StructField("source_page", T.IntegerType(), True),
        ]
    )
    parsed = access.parse_structured(out, "response", schema)
    return parsed.select("event_id", "outcome", "parsed.revenue", "parsed.company", "parsed.source_page")
