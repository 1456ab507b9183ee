"""Declared schemas of the report library, as DDL. Timestamps are UTC instants."""

from __future__ import annotations

LIBRARY_TABLES: dict[str, str] = {
    "users": (
        "id string, email string, password_hash string, created_at timestamp, "
        "quota_documents int, quota_uploads_day int, quota_questions_day int"
    ),
    "documents": (
        "id string, user_id string, filename string, storage_key string, provider_file_ref string, "
        "company string, ticker string, report_type string, fiscal_period string, currency string, "
        "page_count int, status string, stage string, error string, created_at timestamp"
    ),
    "chunks": (
        "id string, document_id string, section string, page_start int, page_end int, text string, "
        "token_count int, chunk_index int"
    ),
    "chunk_embeddings": (
        "id string, document_id string, user_id string, text string, section string, page_start int, "
        "page_end int, chunk_index int, company string, fiscal_period string, report_type string, "
        "embedding array<float>"
    ),
    "index_meta": (
        "id bigint, embedding_provider string, embedding_model string, dimension int, updated_at timestamp"
    ),
    "analyses": (
        "id string, user_id string, type string, document_ids array<string>, result string, "
        "provider string, model string, created_at timestamp"
    ),
    "conversations": (
        "id string, user_id string, document_ids array<string>, created_at timestamp"
    ),
    "messages": (
        "id string, conversation_id string, role string, content string, "
        "citations array<struct<n:int,chunk_id:string,document_id:string,page_start:int,page_end:int>>, "
        "created_at timestamp"
    ),
    "usage": (
        "id bigint, user_id string, kind string, provider string, model string, tokens_in int, "
        "tokens_out int, cost_estimate decimal(10,6), created_at timestamp"
    ),
}

# Nested result of one metrics analysis: every value may be null, every number names its page.
_MONEY = "struct<value:decimal(28,4),unit:string,currency:string,source_page:int>"
METRIC_NAMES = (
    "revenue",
    "cost_of_revenue",
    "gross_income",
    "operating_income",
    "net_income",
    "eps_diluted",
    "operating_cash_flow",
    "free_cash_flow",
    "total_debt",
    "cash",
)
FINANCIAL_METRICS = (
    "company string, fiscal_period string, "
    + ", ".join(f"{m} {_MONEY}" for m in METRIC_NAMES)
    + ", segments array<struct<name:string,value:decimal(28,4),unit:string,currency:string,source_page:int>>"
    + ", guidance array<struct<text:string,source_page:int>>"
    + ", prior struct<fiscal_period:string,"
    + ",".join(f"{m}:{_MONEY}" for m in METRIC_NAMES)
    + ">"
)

# Fixed values of the library's vocabulary.
DOCUMENT_STATUSES = ("queued", "processing", "ready", "failed")
REPORT_TYPES = ("10-K", "10-Q", "annual", "earnings", "other")
STAGE_ORDER = ("store", "metadata", "parse_chunk", "embed_index", "analyze")
